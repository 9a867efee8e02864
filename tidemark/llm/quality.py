"""Quality rules as a short-circuit cascade of native expressions.

A rule is a predicate over measures of the text and a cost in characters visited. On a bounded sample every rule is
evaluated once; from the joint counts of the outcomes the rules are ordered greedily by rows rejected per cost among
the rows that the rules before leave. The cascade is one CASE expression in that order, so a row stops at its first
rejection and dear measures are computed for the few rows that reach them. The order changes the time and which rule is
named first, never the verdict.

Nulls read as empty texts (rejected by the word count). Empty tables keep the declared order. Repeated rows get equal
results, other columns pass through; columns named `kept` and `rejected_by` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, set_apart

#: Rows that decide the order of the rules.
SAMPLE_ROWS = 4_000
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"

Measure = Callable[[str], Column]


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    return F.filter(F.split(whole(text), GAP), lambda w: w != "")


def left_after(text: Column, pattern: str) -> Column:
    """Code points that remain when matches of the pattern are taken out."""
    return F.length(F.regexp_replace(whole(text), pattern, ""))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(whole(text), "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def repeated_words(text: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Texts without a repeated window stop at the distinct count."""
    def windows(ws: Column) -> Column:
        return F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
                           lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1), F.lit(" "), F.get(ws, i + 2)))

    def covered(ws: Column) -> Column:
        placed = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return let(placed, lambda ps: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(ps, lambda p, j: F.coalesce(F.get(ps, j - 1)["w"] == p["w"], F.lit(False))
                     | F.coalesce(F.get(ps, j + 1)["w"] == p["w"], F.lit(False))),
            lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))))

    return let(word_list(text), lambda words: let(windows(words), lambda ws: F.when(
        F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(covered(ws))))


#: Measures by name, each an expression over a text column.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(word_list(t)).cast("long"),
    "word_chars": lambda t: left_after(t, GAP).cast("long"),
    "n_symbols": lambda t: (F.length(whole(t)) - left_after(t, SYMBOLS)).cast("long"),
    "n_bangs": lambda t: (F.length(whole(t)) - left_after(t, "!+")).cast("long"),
    "n_capitals": lambda t: (F.length(whole(t)) - left_after(t, "[A-Z]+")).cast("long"),
    "n_lines": lambda t: F.size(F.filter(F.split(whole(t), "\n"), lambda line: line.rlike(WORD))).cast("long"),
    "n_dup_lines": lambda t: duplicate_lines(t).cast("long"),
    "n_repeat_words": lambda t: repeated_words(t).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """`reject` over measures; `passes`: visits of each character that its measures take, the unit of cost."""

    name: str
    reject: Callable[[Measure], Column]
    passes: float


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50, 3),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"), 12),
    Rule("symbols", lambda m: 4 * m("n_symbols") > m("n_words"), 5),
    Rule("exclamations", lambda m: 2 * m("n_bangs") > m("n_words"), 5),
    Rule("capitals", lambda m: 10 * m("n_capitals") > 6 * m("word_chars"), 4),
    Rule("word_length", lambda m: (2 * m("word_chars") < 5 * m("n_words")) | (m("word_chars") > 12 * m("n_words")), 5),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines"), 5),
)


def from_text(text: Column) -> Measure:
    return lambda name: MEASURES[name](text)


def from_columns(name: str) -> Column:
    return F.col(name)


def measured(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """`docs` with the named measures as columns."""
    return docs.withColumns({n: MEASURES[n](F.col(text)) for n in names})


def cascade_order(docs: DataFrame, rules=RULES, text: str = "text") -> list[Rule]:
    """Rules by rows rejected per cost on a sample, each among the rows that the rules before it leave."""
    rows = docs.count()
    if not rows:
        return list(rules)
    bits = sum((F.when(F.coalesce(r.reject(from_text(F.col(text))), F.lit(False)), F.lit(1 << k)).otherwise(0)
                for k, r in enumerate(rules)), F.lit(0))
    step = 1 << 20
    share = max(1, min(step, int(step * SAMPLE_ROWS / rows)))
    seen = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(step)) < share).select(
        bits.alias("bits"), F.length(whole(F.col(text))).alias("n")).groupBy("bits").agg(
        F.count("*").alias("rows"), F.sum("n").alias("chars")).collect()
    order, left, open_rules = [], [(r["bits"], r["rows"], r["chars"]) for r in seen], list(enumerate(rules))
    while open_rules:
        chars = max(1, sum(c for _, _, c in left))
        worth = {k: sum(n for b, n, _ in left if b >> k & 1) / (r.passes * chars) for k, r in open_rules}
        k, best = max(open_rules, key=lambda kr: (worth[kr[0]], -kr[1].passes, -kr[0]))
        order.append(best)
        open_rules.remove((k, best))
        left = [x for x in left if not x[0] >> k & 1]
    return order


def cascade(docs: DataFrame, order, measure: Measure) -> DataFrame:
    """`docs` with rejected_by (first rule that rejects, null if none) and kept."""
    chain = None
    for rule in order:
        hit = F.coalesce(rule.reject(measure), F.lit(False))
        chain = F.when(hit, rule.name) if chain is None else chain.when(hit, rule.name)
    return docs.withColumn("rejected_by", chain).withColumn("kept", F.col("rejected_by").isNull())


#: Measures that most rules ask for; taken once, ahead of the cascade.
SHARED = ("n_words", "word_chars")


def verdicts(docs: DataFrame, rules=RULES) -> DataFrame:
    """`docs` with rejected_by and kept; beyond the shared measures, one is taken only where the cascade reaches it."""
    ahead = docs.withColumns({f"_{n}": MEASURES[n](F.col("text")) for n in SHARED})
    told = cascade(ahead, cascade_order(docs, rules), lambda n: F.col(f"_{n}") if n in SHARED else MEASURES[n](F.col("text")))
    return told.drop(*[f"_{n}" for n in SHARED])


def passed(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows of `docs` that no rule rejects, with the columns of `docs`, whatever their names."""
    held, own = set_apart(docs, text=F.col("text"))
    return verdicts(held, rules).where("kept").select(*own)


def measured_verdicts(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, all measures, base_failed and kept of every row."""
    full = measured(docs.select("doc_id", "text"), list(MEASURES))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cascade(full, cascade_order(docs, rules), from_columns).withColumn("base_failed", base)
