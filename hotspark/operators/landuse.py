"""Land-use and boundary layers: tag rules, class codes, coverage, dissolving, fragmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.functions.geom import box_distance
from hotspark.operators.components import components
from hotspark.operators.ranking import number_within
from hotspark.operators.tiles import box_pairs, cover, key_points, levels_in
from hotspark.session import materialize

# Land uses taken as industry.
INDUSTRY = ["industrial", "landfill", "quarry", "military"]

# Tag rules of the five fuel categories; tags of a rule are joined by AND, rules by OR.
FUEL_RULES = {
    1: [{"landuse": "forest", "leaf_type": "needleleaved"}, {"natural": "wood", "leaf_type": "needleleaved"}],
    2: [{"landuse": "forest", "leaf_type": "mixed"}, {"natural": "wood", "leaf_type": "mixed"}],
    3: [
        {"landuse": "forest", "leaf_type": "brodleaved"}, {"natural": "wood", "leaf_type": "brodleaved"},
        {"natural": "scrub"}, {"natural": "meadow"}, {"natural": "grassland"},
    ],
    4: [{"natural": "heath"}],
    5: [{"natural": "wetlands"}],
}

# Land-cover class codes of the five fuel categories.
FUEL_CODES = {
    1: [111, 113, 121, 123],
    2: [115, 116, 125, 126],
    3: [112, 114, 122, 124, 20, 30],
    4: [90],
    5: [100],
}

POLYGONAL = ["Polygon", "MultiPolygon"]


def is_industry(tags: Column, kind: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("landuse")).isin(INDUSTRY), F.lit(False)) & kind.isin(POLYGONAL)


def fuel_categories(tags: Column) -> Column:
    """Array of the categories whose rules the tags meet."""
    hits = []
    for category, rules in FUEL_RULES.items():
        any_rule = F.lit(False)
        for rule in rules:
            every = F.lit(True)
            for key, value in rule.items():
                every = every & F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))
            any_rule = any_rule | every
        hits.append(F.when(any_rule, F.lit(category)))
    return F.array_compact(F.array(*hits))


def fuel_of_code(code: Column) -> Column:
    """Fuel category of a land-cover code, NULL for other codes."""
    out = None
    for category, codes in FUEL_CODES.items():
        out = F.when(code.isin(codes), category) if out is None else out.when(code.isin(codes), category)
    return out


def select_codes(borders: DataFrame, selection: DataFrame) -> DataFrame:
    """Borders named by a selection: `codes` is a comma list (any of them), `code2` an extra condition."""
    wanted = selection.withColumn("code", F.explode(F.split("codes", ","))).select("code", "code2")
    cond = (borders["sov"] == wanted["code"]) & (wanted["code2"].isNull() | (borders["adm"] == wanted["code2"]))
    return borders.join(wanted, cond, "left_semi")


def dedupe_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Append _0, _1, ... to names that occur more than once, in the given order."""
    numbered = number_within(df, [name], order, "_k")
    sizes = df.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    joined = numbered.join(sizes, numbered[name].eqNullSafe(sizes["_name"]))
    label = F.when(F.col("_n") > 1, F.concat_ws("_", F.col(name), F.col("_k") - 1)).otherwise(F.col(name))
    return joined.withColumn(name, label).drop("_k", "_n", "_name")


# --- coverage of a country by its boundaries, on cells -------------------------

CANDIDATE_LEVELS = [8, 9]
FILL_FROM, FILL_TO = 10, 4


def reference_cells(cells: DataFrame) -> DataFrame:
    """Cells of each country's reference shape, with the level it came from.

    Level 2 if there is one; else the largest shape of levels 3 to 5; else all
    shapes. Needs country, poly_id, level, cx, cy.
    """
    sizes = cells.groupBy("country", "poly_id", "level").agg(F.count("*").alias("n"))
    pick = sizes.groupBy("country").agg(
        F.max(F.when(F.col("level") == 2, 1)).alias("has2"),
        F.min(F.when(F.col("level").between(3, 5), F.struct((-F.col("n")).alias("s"), F.col("poly_id").alias("p"), F.col("level").alias("l")))).alias("mid"),
    )
    j = cells.join(pick, "country")
    use = (
        F.when(F.col("has2") == 1, F.col("level") == 2).when(F.col("mid").isNotNull(), F.col("poly_id") == F.col("mid.p")).otherwise(F.lit(True))
    )
    ref_level = F.when(F.col("has2") == 1, 2).otherwise(F.col("mid.l"))
    return j.where(use).select("country", "cx", "cy", ref_level.cast("int").alias("ref_level")).distinct()


def coverage_by_level(cells: DataFrame, ref: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Share of the reference covered by each candidate level (0 where a level is absent)."""
    levels = levels or CANDIDATE_LEVELS
    area = ref.groupBy("country").agg(F.count("*").alias("ref_n"), F.first("ref_level").alias("ref_level"))
    hit = cells.where(F.col("level").isin(levels)).select("country", "level", "cx", "cy").distinct().join(
        ref.select("country", "cx", "cy"), ["country", "cx", "cy"], "left_semi"
    ).groupBy("country", "level").agg(F.count("*").alias("hit"))
    every = area.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return every.join(hit, ["country", "level"], "left").select(
        "country", "level", "ref_level", "ref_n", (F.coalesce("hit", F.lit(0)) / F.col("ref_n")).alias("fraction")
    )


def best_level(fractions: DataFrame) -> DataFrame:
    """The candidate level with the largest share (ties: the first)."""
    order = F.struct((-F.col("fraction")).alias("f"), F.col("level").alias("l"))
    return fractions.groupBy("country").agg(F.min_by(F.struct("level", "fraction", "ref_level", "ref_n"), order).alias("b")).select(
        "country", F.col("b.level").alias("best"), F.col("b.fraction").alias("fraction"), F.col("b.ref_level").alias("ref_level"), F.col("b.ref_n").alias("ref_n")
    )


def fill_coverage(cells: DataFrame, ref: DataFrame) -> DataFrame:
    """Cells each boundary contributes: the best level whole, then levels 10 to 4 in the gaps.

    Filling level by level gives every open reference cell to the highest level that
    covers it, so the loop is one aggregate per cell and one join back.
    """
    best = best_level(coverage_by_level(cells, ref)).select("country", "best")
    lv = cells.join(best, "country")
    inside = lv.join(ref.select("country", "cx", "cy", F.lit(1).alias("in_ref")), ["country", "cx", "cy"], "left")
    rank = F.when(F.col("level") == F.col("best"), 100).when(
        F.col("in_ref").isNotNull() & F.col("level").between(FILL_TO, FILL_FROM), F.col("level")
    )
    ranked = inside.withColumn("rank", rank).where("rank is not null")
    top = ranked.groupBy("country", "cx", "cy").agg(F.max("rank").alias("top"))
    return ranked.join(top, ["country", "cx", "cy"]).where(F.col("rank") == F.col("top")).select("country", "poly_id", "level", "cx", "cy")


# --- dissolving ------------------------------------------------------------------


def touch_groups(shapes: DataFrame, id_col: str, reach: float, base: float) -> DataFrame:
    """(id, group): shapes whose boxes are linked by steps of at most `reach`; a group has its lowest id.

    Copies of a box are one vertex, however many there are.
    """
    box = ["x0", "y0", "x1", "y1"]
    copies = materialize(shapes.groupBy(*box).agg(F.min(id_col).alias("v")), "copies")
    pairs = box_pairs(copies, copies, base, reach).where(F.col("a.v") < F.col("b.v")).where(box_distance("a", "b") <= reach)
    roots = components(pairs.select(F.col("a.v").alias("src"), F.col("b.v").alias("dst")))
    rooted = materialize(
        copies.join(roots, copies.v == roots.id, "left").select(*box, "v", F.coalesce("root", "v").alias("root")), "groups"
    )
    lowest = rooted.groupBy("root").agg(F.min("v").alias("grp"))
    return shapes.select(id_col, *box).join(rooted.join(lowest, "root").select(*box, "grp"), box).select(id_col, "grp")


# --- fragmentation ------------------------------------------------------------------


def fragmentation_index(shapes: DataFrame, id_col: str, step: float, box: float, perimeter_ratio: float = 0.05) -> DataFrame:
    """Aggregation index of each box shape: the best value over its sample points.

    Around each point the shapes are cut to a square of side `box`. A square more
    than 80 % full gives 1, less than 10 % full gives 0, else the perimeter is set
    against the compact and the most ragged case. A shape missed by the sample
    points has 0.
    """

    def ticks(lo: str, hi: str) -> Column:
        n = F.ceil((F.col(hi) - F.col(lo)) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.col(lo) + k * step)

    pts = shapes.withColumn("x", F.explode(ticks("x0", "x1"))).withColumn("y", F.explode(ticks("y0", "y1")))
    pts = pts.where(
        (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    ).select(F.col(id_col).alias("pid"), "x", "y")
    half = box / 2
    near = cover(shapes.select("x0", "y0", "x1", "y1"), box, half)
    keyed = key_points(pts, box, levels_in(shapes, box, half))
    met = keyed.join(near, ["lvl", "tx", "ty"])
    w = F.least(F.col("x1"), F.col("x") + half) - F.greatest(F.col("x0"), F.col("x") - half)
    h = F.least(F.col("y1"), F.col("y") + half) - F.greatest(F.col("y0"), F.col("y") - half)
    cut = met.withColumn("w", w).withColumn("h", h).where((F.col("w") > 0) & (F.col("h") > 0))
    per = cut.groupBy("pid", "x", "y").agg(
        (F.sum(F.col("w") * F.col("h")) / 1e4).alias("area"), (F.sum(2 * (F.col("w") + F.col("h"))) * 1e-3).alias("rim")
    )
    full = box * box * 1e-4
    ragged = perimeter_ratio * 1e4 * F.col("area") * 1e-3
    compact = 2 * math.pi * F.sqrt(1e4 * F.col("area") / math.pi) / 1e3
    value = F.when(F.col("area") > 0.8 * full, 1.0).when(F.col("area") < 0.1 * full, 0.0).otherwise(
        1 - (F.col("rim") - compact) / (ragged - compact)
    )
    best = per.withColumn("ai", value).groupBy("pid").agg(F.max("ai").alias("ai"))
    return shapes.join(best, shapes[id_col] == best["pid"], "left").select(id_col, F.coalesce("ai", F.lit(0.0)).alias("ai"))
