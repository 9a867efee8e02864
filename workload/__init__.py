"""The operators bound to the supplied tables, each with the SQL it must agree with."""

from .base import QUERIES, SQL
from . import catalogues, events, extremes, fields, flows, hydro, impact, live, mixture, network, outcomes, peaks, sources  # noqa: F401
