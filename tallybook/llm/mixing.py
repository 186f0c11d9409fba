"""Mixing sources to target weights by capped water-filling.

The target of a source is the water level times its weight, at most ``max_epochs`` times its size; what a full source
cannot take is shared by weight among the rest. The level comes from prefix sums over the sources in the order in
which they fill, which is the limit of repeated redistribution.

Every document is taken ``rate`` times, rate = target / size of its source: the whole part always, the fraction by
systematic sampling. The documents of a source are ranked by size and then by a seeded hash; the k-th one is taken once
more where ``floor((k + 1) * fraction + u)`` steps up. As sizes fall along the ranks, the words taken differ from
the target by at most the size of the largest document. Ranks are counted in slices of at most ``SLICE`` documents
plus the totals before them, so a source with a third of all rows, or one size shared by all, is spread over tasks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources without words get
target 0; rows that repeat both id and text are one unit, but are numbered and taken one by one, in the order of their other columns;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.numbering import numbered
from tallybook.sources.scratch import stored_once

#: Documents ranked by one task at a time, about.
SLICE = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, weights repeat in source order."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    filling = Window.orderBy("ratio", F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    level = (F.col("total") - F.col("full")) / F.col("open")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("limit", max_epochs * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max(level).over(Window.partitionBy()))
        .select("source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))
    )


def mixing_plan(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: float = 2.0,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    slice_size: int = SLICE,
) -> DataFrame:
    """(doc_id, source, unit, rows, nth, size, source_size, target, copies) for every row; ``unit`` is ``unit_of`` the row, ``rows``
    the rows of the unit, and ``nth`` tells them apart, from 0."""
    sized = stored_once(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            unit_of(key, text, seed).alias("unit"),
            size_of(F.col(text)).alias("size"),
        ),
        "mix-sizes",
    )
    units = stored_once(sized.groupBy("source", "unit").agg(F.max("size").alias("words"), F.count("*").alias("rows")), "mix-units")
    levels = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, max_epochs)
    strata = units.groupBy("source", "words").agg(F.ceil(F.count("*") / slice_size).alias("slices"))
    u, s = units.alias("u"), strata.alias("s")
    part = F.conv(F.substring("u.unit", 1, 8), 16, 10).cast("double") / 2.0**32
    sliced = u.join(s, F.col("u.source").eqNullSafe(F.col("s.source")) & (F.col("u.words") == F.col("s.words"))).select(
        "u.source", "u.unit", "u.words", "u.rows", F.floor(part * F.col("s.slices")).alias("slice")
    )
    ahead = Window.partitionBy("source").orderBy(F.desc("words"), "slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy("source", "words", "slice")
        .agg(F.sum("rows").alias("n"))
        .select("source", "words", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )
    earlier = Window.partitionBy("source", "words", "slice").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    inside = sliced.withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    i, b, t = inside.alias("i"), before.alias("b"), levels.alias("t")
    ranked = (
        i.join(
            b,
            F.col("i.source").eqNullSafe(F.col("b.source"))
            & (F.col("i.words") == F.col("b.words"))
            & (F.col("i.slice") == F.col("b.slice")),
        )
        .join(t, F.col("i.source").eqNullSafe(F.col("t.source")))
        .select("i.source", "i.unit", "i.rows", "t.source_size", "t.target", (F.col("before") + F.col("earlier")).alias("rank"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = F.col("rate") - F.floor("rate")
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    step = lambda n: F.floor(n * F.col("fraction") + F.col("shift"))
    chosen = (
        ranked.withColumn("rate", rate)
        .withColumn("fraction", fraction)
        .withColumn("shift", shift.cast("double") / 2.0**32)
    )
    place = F.col("rank") + F.col("nth")
    copies = (F.floor("rate") + step(place + 1) - step(place)).cast("long").alias("copies")
    z, c = _numbered_in_units(sized, units, []).alias("z"), chosen.alias("c")
    same = F.col("z.source").eqNullSafe(F.col("c.source")) & (F.col("z.unit") == F.col("c.unit"))
    return z.join(c, same).select(
        "z.doc_id", "z.source", "z.unit", "c.rows", "z.nth", "z.size", "c.source_size", "c.target", copies
    )


def _numbered_in_units(rows: DataFrame, units: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their number ``nth`` in their unit. Rows of units of their own need no shuffle for that; those of
    repeated units are dealt by one range exchange, so a unit of a third of all rows is in many tasks."""
    repeated = units.where("rows > 1").select("source", "unit")
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    r, u = rows.alias("r"), repeated.alias("u")
    same = F.col("r.source").eqNullSafe(F.col("u.source")) & (F.col("r.unit") == F.col("u.unit"))
    once = r.join(u, same, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    dealt = numbered(r.join(u, same, "left_semi"), [F.asc_nulls_last("source"), F.asc("unit"), *order])
    firsts = dealt.groupBy("source", "unit").agg(F.min("position").alias("first"))
    d, f = dealt.alias("d"), firsts.alias("f")
    nth = (F.col("d.position") - F.col("f.first")).alias("nth")
    many = d.join(f, F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.unit") == F.col("f.unit")))
    return once.unionByName(many.select(*[F.col(f"d.`{c}`") for c in rows.columns], nth))


def unit_of(key: str, text: str, seed: int) -> Column:
    """What identifies a document, and its seeded place among documents of its size."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, with all its columns."""
    plan = mixing_plan(docs, seed=seed, key=key, text=text, source=source, **how)
    plan = stored_once(plan.select("source", "unit", "rows", "nth", "copies"), "mix-plan")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col(source).cast("string").alias("source"), unit_of(key, text, seed).alias("unit"), whole)
    # Equal rows can change places; rows that differ in another column are told apart by it.
    keyed = _numbered_in_units(keyed, plan.groupBy("source", "unit").agg(F.max("rows").alias("rows")), [F.xxhash64(F.to_json("row")).asc()])
    d, p = keyed.alias("d"), plan.where("copies > 0").alias("p")
    same = (F.col("d.unit") == F.col("p.unit")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.nth") == F.col("p.nth"))
    taken = d.join(p, same).select("d.row", F.explode(F.array_repeat(F.lit(1), F.col("p.copies").cast("int"))).alias("n"))
    return taken.select("row.*")
