"""River network, soil, waterbody and point-location operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kit.blocks import quantiles, row_numbers
from ..kit.cells import in_boxes
from ..kit.common import clip, cut, finite, settle
from ..kit.graph import drains_to
from ..kit.intervals import _first_side, nearest, within_distance
from ..kit.neighbours import nearest_members

# Usable soil groups in order, layer depths (cm), organic-matter to carbon factor, ksat um/s to mm/h.
SOIL_GROUPS = ("A", "B", "C", "D")
LAYER_DEPTHS_CM = (0.0, 5.0, 15.0, 30.0, 60.0, 100.0, 200.0)
OM_TO_OC = 1.724
UMS_TO_MMHR = 3.6
#: Points around a point in one round of the ordered dedupe, roughly.
ROUND_NEIGHBOURS = 8


def upstream(reaches: DataFrame, outlets: DataFrame, node: str = "hydroseq", down: str = "dnhydroseq", outlet: str = "outlet") -> DataFrame:
    """(reach, outlet): all reaches draining to each outlet through downstream links, the outlet included."""
    return drains_to(reaches, outlets, node, down, outlet)


def area_match(df: DataFrame, found: str, reviewed: str, limit_pct: float = 50.0) -> DataFrame:
    """Absolute area difference in percent and its status."""
    r = finite(reviewed)
    d = F.when(r > 0, F.abs(finite(found) - r) / r * 100.0)
    return df.withColumn("area_difference_pct", d).withColumn("area_match_status", F.when(F.col("area_difference_pct").isNull(), "missing_reviewed_area").when(
        F.col("area_difference_pct") > limit_pct, "review_required_area_mismatch").otherwise("within_review_tolerance"))


def soil_group(raw: Column, rule: str = "undrained") -> Column:
    """Usable hydrologic group of a code such as A/D under a drainage rule, null when none."""
    parts = F.filter(F.transform(F.split(raw, "/"), lambda p: F.substring(F.upper(F.trim(p)), 1, 1)), lambda p: p.isin(*SOIL_GROUPS))
    pick = {"drained": F.element_at(parts, 1), "undrained": F.element_at(parts, -1), "conservative": F.array_max(parts)}[rule]
    return F.when(F.size(parts) > 0, pick)


def soil_infiltration(horizons: DataFrame, rule: str = "undrained", top_cm: float = 40.0, key: str = "mukey", order: str = "hzdept_r", factor: float = UMS_TO_MMHR) -> DataFrame:
    """Soil group of the first usable horizon and thickness-weighted harmonic conductivity of the top layer (mm/h)."""
    g = soil_group(F.col("hydgrp"), rule)
    k = finite("ksat_r")
    t = F.greatest(clip(finite("hzdepb_r"), 0.0, top_cm) - clip(finite("hzdept_r"), 0.0, top_cm), F.lit(0.0))
    ok = (k > 0) & (t > 0)
    a = horizons.groupBy(key).agg(F.min(F.when(g.isNotNull(), F.struct(F.col(order).alias("o"), g.alias("g")))).alias("_g"),
                                  F.sum(F.when(ok, t)).alias("_t"), F.sum(F.when(ok, t / k)).alias("_r"))
    code = F.array_position(F.array(*[F.lit(x) for x in SOIL_GROUPS]), F.col("hsg"))
    return a.select(key, F.col("_g.g").alias("hsg"), (F.col("_t") / F.col("_r") * factor).alias("ksat_mmhr")).dropna().withColumn("hsg_code", code)


SOIL_FIELDS = {"bd": "dbthirdbar_r", "oc": "om_r", "ph": "ph1to1h2o_r", "clyppt": "claytotal_r", "sltppt": "silttotal_r", "sndppt": "sandtotal_r"}


def soil_layers(horizons: DataFrame, key: str = "mukey", depths=LAYER_DEPTHS_CM) -> DataFrame:
    """Soil properties at fixed depths: the horizon covering the depth, below the profile the deepest, else the nearest top.

    One reduction per key over all depths, before anything is shuffled. Below the profile only a horizon that ends at the depth
    counts, and then the profile ends there too, so its depth need not be known first.
    """
    h = horizons.select(key, finite("hzdept_r").alias("_top"), finite("hzdepb_r").alias("_bot"), *[finite(c).alias(f"_{n}") for n, c in SOIL_FIELDS.items()]).where("_bot > _top")
    rest = [F.col("_top").alias("t"), *[F.col(f"_{n}").alias(n) for n in SOIL_FIELDS]]
    least = []
    for i, d in enumerate(depths, 1):
        covers = (F.col("_top") <= d) & (F.col("_bot") > d)
        least += [F.min(F.when(covers, F.struct(*rest))).alias(f"_0_{i}"), F.min(F.when(F.col("_bot") == d, F.struct(*rest))).alias(f"_1_{i}"),
                  F.min(F.when(~covers, F.struct(F.abs(F.col("_top") - d).alias("k"), *rest))).alias(f"_2_{i}")]
    a = h.groupBy(key).agg(F.max("_bot").alias("_max"), *least)
    cols = []
    for i, d in enumerate(depths, 1):
        first, ends, near = (F.col(f"_{r}_{i}") for r in range(3))
        for n in SOIL_FIELDS:
            got = F.when(first.isNotNull(), first[n]).when(F.col("_max") == d, ends[n]).otherwise(near[n])
            cols.append((got / OM_TO_OC if n == "oc" else got).alias(f"{n}_sl{i}"))
    return a.select(key, F.least(F.lit(200.0), F.col("_max")).alias("soilthickness"), *cols).dropna()


def enrich_rivers(rivers: DataFrame, geometry: DataFrame, key: str = "comid", label: str = "measured", fallback: str = "fallback") -> DataFrame:
    """Width and depth from the first geometry row per key; source says where each river's values come from."""
    g = geometry.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("row_id", "width_m", "depth_m")).alias("g"))
    j = rivers.join(g, key, "left")
    w, d = F.col("g.width_m"), F.col("g.depth_m")
    return j.select(*rivers.columns, F.coalesce(w, F.col("default_width_m")).alias("rivwth"), d.alias("rivdph"), F.when(w.isNotNull(), label).otherwise(fallback).alias("rivwth_source"))


def transfer_attributes(rivers: DataFrame, reference: DataFrame, k: int = 5, rid: str = "river_id", ref_id: str = "ref_id") -> DataFrame:
    """Median width and depth of the k reference rivers nearest in (2 x order, log10 area, log10 length), exact.

    The search goes down a tree of boxes over all three, so a river meets the references of a few leaves.
    """
    def feats(df, p, key, *more):
        lg = lambda c: F.log10(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(1e-6)))
        return df.select(F.col(key), lg("area").alias(f"{p}_a"), (F.greatest(F.coalesce(finite("order"), F.lit(0.0)), F.lit(0.0)) * 2.0).alias(f"{p}_o"), lg("length").alias(f"{p}_l"), *more)
    dist = F.sqrt((F.col("t_a") - F.col("m_a")) ** 2 + (F.col("t_o") - F.col("m_o")) ** 2 + (F.col("t_l") - F.col("m_l")) ** 2)
    near = nearest_members(feats(rivers, "t", rid), feats(reference, "m", ref_id, "width_m", "depth_m"), rid, ref_id, {"a": 1.0, "o": 1.0, "l": 1.0}, dist, k)
    # At most k rows per river, so the built-in exact median is bounded.
    return near.groupBy(rid).agg(F.percentile("width_m", 0.5).alias("width_m"), F.percentile("depth_m", 0.5).alias("depth_m"), F.max("distance").alias("farthest"))


#: Squares that a segment crosses at first, on average at most.
PIECES = 16


def nearest_flowline(points: DataFrame, segments: DataFrame, limit: float, pid: str = "point_id", line: str = "line_id") -> DataFrame:
    """Nearest line of each point within the limit, ties kept: (pid, line, distance).

    `segments` has x1, y1, x2, y2; distances equal to nine decimals tie. A segment is put on every grid square it crosses. A point
    looks at its own square, small at first, and what is nearer than the border is proven; the others look at 3 x 3 squares,
    then at larger ones up to the limit. So a point meets a few segments however many lie within the limit.
    """
    size, around, spot = float(limit), 0, [pid, "_px", "_py"]
    whole = lambda *c: sum(F.abs(x) for x in c) < float("inf")
    ends = ["x1", "y1", "x2", "y2"]
    seg = cut(segments.where(whole(*ends)).select(line, *[F.col(c).cast("double").alias(c) for c in ends]))
    left = points.where(whole("x", "y") & F.col(pid).isNotNull()).select(pid, F.col("x").cast("double").alias("_px"), F.col("y").cast("double").alias("_py"))
    span = seg.agg(F.avg(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))).first()[0] or 0.0
    middle = seg.select(((F.col("x1") + F.col("x2")) / 2).alias("_cx"), ((F.col("y1") + F.col("y2")) / 2).alias("_cy")).distinct()
    size, out = min(size, max(_first_side(middle, size), span / PIECES)), None
    while True:
        last = around > 0 and size >= limit
        near = _crossed(left, seg, size, around).where(F.col("distance") <= float(limit)).withColumn("_key", F.floor(F.col("distance") * 1e9 + 0.5))
        near = near.withColumn("_r", F.rank().over(Window.partitionBy(*spot).orderBy("_key"))).where("_r = 1")
        if not last:
            near = cut(near.where(F.col("_key") / 1e9 + 1e-8 <= F.col("_safe")))
        near = near.select(*spot, line, "distance", "_key")
        out = near if out is None else out.unionByName(near)
        if last:
            break
        left = cut(left.join(near.select(*spot).distinct(), spot, "left_anti"))
        if left.isEmpty():
            break
        around, size = 1, size if around == 0 else min(size * 4.0, float(limit))
    best = out.withColumn("_r", F.rank().over(Window.partitionBy(pid).orderBy("_key"))).where("_r = 1")
    return best.groupBy(pid, line).agg(F.min("distance").alias("distance"))


def _crossed(points: DataFrame, seg: DataFrame, size: float, around: int) -> DataFrame:
    """Points with the segments of the squares around them: all columns, `distance` and `_safe`, up to which no segment is missed."""
    fl = lambda c: F.floor(c / size)
    x, y = F.col("_px"), F.col("_py")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cols = seg.withColumn("_gx", F.explode(F.sequence(fl(F.least("x1", "x2")), fl(F.greatest("x1", "x2")))))
    # The part of the segment between the sides of the column; a little more, for rounding.
    share = lambda i: F.when(dx != 0, F.least(F.greatest(((F.col("_gx") + i) * size - F.col("x1")) / dx, F.lit(0.0)), F.lit(1.0))).otherwise(float(i))
    ya, yb = (F.col("y1") + dy * share(i) for i in (0, 1))
    pad = size * 1e-6 + F.greatest(F.abs("x1"), F.abs("x2"), F.abs("y1"), F.abs("y2")) * 1e-12
    squares = cols.withColumn("_gy", F.explode(F.sequence(fl(F.least(ya, yb) - pad), fl(F.greatest(ya, yb) + pad))))
    ways = range(-around, around + 1)
    p = points.withColumn("_gx", fl(x)).withColumn("_gy", fl(y))
    edge = F.least(x - F.col("_gx") * size, (F.col("_gx") + 1) * size - x, y - F.col("_gy") * size, (F.col("_gy") + 1) * size - y)
    p = p.withColumn("_safe", edge + around * size)
    for c in ("_gx", "_gy"):
        p = p.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in ways])))
    t = F.coalesce(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    d = F.sqrt((x - F.col("x1") - t * dx) ** 2 + (y - F.col("y1") - t * dy) ** 2)
    return p.join(squares, ["_gx", "_gy"]).withColumn("distance", d)


def waterbodies(df: DataFrame, rivers: DataFrame | None, depth_m: float = 3.0, discharge: float = 1.0, min_km2: float = 1.0, ftype: int = 390, limit: float = 5000.0) -> DataFrame:
    """Reservoir table: lakes of the type and size by falling area, default depth, discharge of the nearest river within the limit (floored)."""
    w = df.where((F.col("ftype") == ftype) & (finite("areasqkm") >= min_km2)).withColumn("_na", -finite("areasqkm"))
    w = cut(row_numbers(w, None, "_na", name="waterbody_id", then=("nhdplusid",)).drop("_na"))
    out = w.withColumn("Area_avg", finite("areasqkm") * 1e6).withColumn("Depth_avg", F.lit(float(depth_m))).withColumn("Vol_avg", F.col("Area_avg") * float(depth_m))
    q = F.lit(None).cast("double")
    if rivers is not None:
        r = rivers.where(finite("qbankfull").isNotNull()).select("river_id", F.col("x").alias("rx"), F.col("y").alias("ry"), finite("qbankfull").alias("_q"))
        # Rivers on one spot tie: the largest discharge there counts.
        spot = r.groupBy("rx", "ry").agg(F.min("river_id").alias("river_id"), F.max("_q").alias("_q"))
        near = nearest(out, spot, "waterbody_id", "x", "y", "river_id", "rx", "ry", limit)
        out = out.join(near.select("waterbody_id", "river_id"), "waterbody_id", "left").join(spot.select("river_id", "_q"), "river_id", "left").drop("river_id")
        q = F.col("_q")
    return out.withColumn("Dis_avg", F.greatest(F.coalesce(q, F.lit(float(discharge))), F.lit(float(discharge)))).drop("_q")


def river_formulas(df: DataFrame, area: str = "totdasqkm") -> DataFrame:
    """Width max(10, 5 + 2.5 sqrt A) and bankfull discharge max(1, 2 A^0.8); area defaults to 100 and is at least 1."""
    a = F.greatest(F.coalesce(finite(area), F.lit(100.0)), F.lit(1.0))
    return df.withColumn("rivwth", F.greatest(F.lit(10.0), 5.0 + 2.5 * F.sqrt(a))).withColumn("qbankfull", F.greatest(F.lit(1.0), 2.0 * F.pow(a, F.lit(0.8))))


def inflow_crossings(lines: DataFrame, boxes: DataFrame, min_area: float, line: str = "line_id") -> DataFrame:
    """Points where rivers that end inside a box meet its boundary, ranked by drainage area per box.

    `lines` has vertices array<struct<x,y>> and uparea; `boxes` is (box_id, xmin, ymin, xmax, ymax); river ends and boxes meet on quadtree cells. A stretch lying
    on an edge counts once, at its middle.
    """
    v = lines.where(finite("uparea") >= min_area)
    last = F.element_at("vertices", -1)
    ended = v.withColumn("_ex", last["x"]).withColumn("_ey", last["y"])
    ends = in_boxes(ended, boxes.select("box_id", "xmin", "ymin", "xmax", "ymax"), "_ex", "_ey", "xmin", "xmax", "ymin", "ymax")
    seg = ends.select(line, "uparea", "box_id", "xmin", "ymin", "xmax", "ymax", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("vertices") - 1), lambda i: F.struct(F.element_at("vertices", i).alias("a"), F.element_at("vertices", i + 1).alias("b")))).alias("s"))
    ax, ay, bx, by = (F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y"))

    def edge(c, p, q, lo, hi, r0, r1, vertical):
        """Crossing of the segment with the edge line p-axis = c between lo and hi on the other axis."""
        t = (F.col(c) - p) / F.nullif(q - p, F.lit(0.0))
        o = r0 + t * (r1 - r0)
        hit = F.when((t >= 0) & (t <= 1) & (o >= F.col(lo)) & (o <= F.col(hi)), o)
        flat = (p == q) & (p == F.col(c))
        m0, m1 = F.greatest(F.least(r0, r1), F.col(lo)), F.least(F.greatest(r0, r1), F.col(hi))
        o = F.when(flat & (m0 <= m1), (m0 + m1) / 2).otherwise(hit)
        return F.when(o.isNotNull(), F.struct((F.col(c) if vertical else o).alias("x"), (o if vertical else F.col(c)).alias("y")))

    pts = F.array(edge("xmin", ax, bx, "ymin", "ymax", ay, by, True), edge("xmax", ax, bx, "ymin", "ymax", ay, by, True),
                  edge("ymin", ay, by, "xmin", "xmax", ax, bx, False), edge("ymax", ay, by, "xmin", "xmax", ax, bx, False))
    hits = seg.withColumn("_p", F.explode(F.filter(pts, lambda p: p.isNotNull()))).select(
        "box_id", line, "uparea", F.round("_p.x", 6).alias("x"), F.round("_p.y", 6).alias("y")).distinct()
    return row_numbers(hits.withColumn("_n", -finite("uparea")), ["box_id"], "_n", name="crossing_rank", then=(line, "x", "y")).drop("_n")


def gauge_distance_qa(sources: DataFrame, gauges: DataFrame, limit: float = 100.0, reservoir_limit: float | None = None, sid: str = "handoff_id") -> DataFrame:
    """Per id: distance to the matched gauge against its limit, or missing / stale."""
    lim = F.lit(limit) if reservoir_limit is None else F.when(F.lower("placement") == "reservoir_boundary_inflow", float(reservoir_limit)).otherwise(float(limit))
    s = sources.select(sid, F.col("x").alias("_sx"), F.col("y").alias("_sy"), lim.alias("limit_m"), F.lit(1).alias("_s"))
    g = gauges.select(sid, F.col("x").alias("_gx"), F.col("y").alias("_gy"), F.lit(1).alias("_g"))
    d = F.sqrt((F.col("_sx") - F.col("_gx")) ** 2 + (F.col("_sy") - F.col("_gy")) ** 2)
    j = s.join(g, sid, "full").groupBy(sid).agg(F.min(d).alias("distance_m"), F.max("limit_m").alias("limit_m"), F.max("_s").alias("_s"), F.max("_g").alias("_g"))
    st = F.when(F.col("_g").isNull(), "missing").when(F.col("_s").isNull(), "stale").when(F.col("distance_m") > F.col("limit_m"), "too_far").otherwise("passed")
    return j.select(sid, "distance_m", "limit_m", st.alias("status"))


def condition_cells(cells: DataFrame, scale: float = 1.0, cap: float | None = None, smax: float | None = None, ksat: str = "ksat", theta: str = "theta") -> DataFrame:
    """Scaled and capped conductivity with a capped flag; recovery storage clip(theta) * smax when asked."""
    s = finite(ksat) * float(scale)
    out = cells.withColumn("capped", F.coalesce(s > cap, F.lit(False)) if cap is not None else F.lit(False)).withColumn(
        "ksat_conditioned", F.when(s.isNotNull(), F.least(s, F.lit(float(cap)))) if cap is not None else s)
    return out.withColumn("storage", clip(finite(theta), 0.0, 1.0) * float(smax)) if smax is not None else out


def cap_share(cells: DataFrame, cap: float, limit: float, by=None, ksat: str = "ksat_conditioned") -> DataFrame:
    """Share of positive cells at the cap, an error when above the limit."""
    v = F.when(finite(ksat) > 0, finite(ksat))
    g = cells.groupBy(*([by] if isinstance(by, str) else by or [])).agg(F.count(v).alias("positive_cells"), F.avg((F.abs(v - cap) <= 1e-8 + 1e-5 * abs(cap)).cast("double")).alias("cap_fraction"))
    return g.withColumn("status", F.when(F.col("positive_cells") == 0, "ksat_empty").when(F.col("cap_fraction") > limit, "ksat_cap_fraction_high").otherwise("ok"))


def dedupe_points(points: DataFrame, d: float = 0.0, pid: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """d = 0: first point per coordinates to 3 decimals. d > 0: in id order, drop points within d of a kept one.

    The ordered rule runs in rounds: a point before all its remaining neighbours is kept, its neighbours leave.
    """
    if d <= 0:
        first = points.groupBy(F.round(x, 3).alias("_x"), F.round(y, 3).alias("_y")).agg(F.min(pid).alias(pid))
        return points.join(first.select(pid), pid, "left_semi")
    # Copies on one spot: only the first can be kept, so they collapse before neighbours are sought.
    left = settle(points.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.min(pid).alias("_id")))
    kept, n = [], left.count()
    while n:
        # The first ids go ahead, so few that a point has some ROUND_NEIGHBOURS others around it: kept points lie d apart, so
        # what these leave over of the rest meets few of them, and no two crowds are ever joined with each other.
        crowd = left.groupBy(F.floor(F.col("_x") / d), F.floor(F.col("_y") / d)).agg(F.count(F.lit(1)).alias("k"))
        share = ROUND_NEIGHBOURS * n / crowd.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0]
        now = left
        if share < 0.5:
            seen = left.sample(min(1.0, 4000.0 / n), seed=1).orderBy("_id").select("_id").collect()  # decides the batch, not the result
            if seen:
                now = left.where(F.col("_id") <= F.lit(seen[int(share * len(seen))][0]))
        first = _first_apart(now, d)
        kept.append(first)
        left = settle(left.join(_beside(left, first, d), "_id", "left_anti"))
        n = left.count()
    if not kept:
        return points
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    return points.join(every.select(F.col("_id").alias(pid)), pid, "left_semi")


def _beside(left: DataFrame, chosen: DataFrame, d: float) -> DataFrame:
    return within_distance(left, chosen.select(F.col("_x").alias("_ox"), F.col("_y").alias("_oy")), "_x", "_y", "_ox", "_oy", d).select("_id").distinct()


def _first_apart(left: DataFrame, d: float) -> DataFrame:
    """The rows that the ordered rule keeps: in rounds, those before all their remaining neighbours."""
    left, kept = settle(left), None
    while not left.isEmpty():
        other = left.select(F.col("_id").alias("_o"), F.col("_x").alias("_ox"), F.col("_y").alias("_oy"))
        near = within_distance(left, other, "_x", "_y", "_ox", "_oy", d)
        first = settle(near.groupBy("_id", "_x", "_y").agg(F.min("_o").alias("_m")).where("_m = _id").drop("_m"))
        kept = first if kept is None else kept.unionByName(first)
        left = settle(left.join(_beside(left, first, d), "_id", "left_anti"))
    return settle(kept)


def river_qa(rivers: DataFrame, numeric: list[str], sources: list[str], label: str) -> DataFrame:
    """Check rows: each numeric column finite somewhere, positive and varying; source text names the label, not fallback only."""
    out = None
    for c in numeric:
        if c not in rivers.columns:
            row = rivers.sparkSession.createDataFrame([(c, "failed")], "check string, status string")
        else:
            v = finite(c)
            row = rivers.agg((F.coalesce(F.min(v) > 0, F.lit(False)) & F.coalesce(F.max(v) > F.min(v), F.lit(False)) & (F.count(v) == F.count(F.lit(1)))).alias("_ok")).select(
                F.lit(c).alias("check"), F.when(F.col("_ok"), "passed").otherwise("failed").alias("status"))
        out = row if out is None else out.unionByName(row)
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sources if c in rivers.columns]
    text = F.concat_ws(" ", *names) if names else F.lit("")
    src = rivers.agg(F.coalesce(F.bool_or(text.contains(label)), F.lit(False)).alias("_ok")).select(F.lit("geometry_source").alias("check"), F.when(F.col("_ok"), "passed").otherwise("failed").alias("status"))
    return src if out is None else out.unionByName(src)


def id_pairs_qa(areas: DataFrame, outlets: DataFrame, key: str = "waterbody_id") -> DataFrame:
    """Ids with an area but no outlet, or an outlet but no area."""
    a, o = areas.select(key).distinct(), outlets.select(key).distinct()
    return a.join(o, key, "left_anti").withColumn("issue", F.lit("area_without_outlet")).unionByName(o.join(a, key, "left_anti").withColumn("issue", F.lit("outlet_without_area")))
