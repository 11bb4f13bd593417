"""Mixing sources to target weights by hash-threshold histograms (built-in SQL functions only).

Every document has a 36-bit position, a hash of its id. Sizes are summed by source and the upper
12 bits; the first bucket in which a source's running sum reaches its budget is the boundary. Only
documents of the boundary bucket are summed again by the next 12 bits, and once more by the last.
The budget thus becomes one threshold per source: a document is taken when its position is below
it. No documents are sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

LEVELS, BITS = 3, 12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``source, source_size, target`` from a frame with ``source, size``.

    The sources by code point, null last, weigh ``weights``, repeated. They share ``share`` times
    all sizes by weight, but none gets more than ``repeats`` times its own size; the excess is
    shared anew by weight until no target is above. One row per source is windowed, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(repeats))
    full = per.withColumn("weight", weight).withColumn("ratio", most / F.col("weight"))
    # in this order the capped sources come first; `level` is what a weight of 1 gets if all before are capped
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(repeats))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = full.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    shared = F.min(F.when(F.col("free"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levels.withColumn("shared", shared).select("source", "source_size", F.when(F.col("free"), F.col("shared") * F.col("weight")).otherwise(most).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, copies, source``, and the
    columns in ``carry`` as ``carry_<name>``.

    ``size`` counts words (runs of other characters than U+0020, U+0009 to U+000D); a null text has
    none. ``copies`` is how often the mix takes the document (0 to ``repeats``), ``taken`` is
    ``size * copies``. A source's taken words differ from its target by at most half the size of the
    documents that share the boundary position. Positions are hashes of the id (of the text where
    the id is null), so reruns agree and rows with one id are taken together. A null source is a
    source; an empty table gives no rows; columns that aren't in ``carry`` are ignored.
    """
    text, ident = F.col(text_col), F.col(id_col)
    key = F.coalesce(ident.cast("string"), F.concat(F.lit("text:"), text), F.lit("null"))
    position = F.conv(F.substring(F.md5(key), 1, LEVELS * BITS // 4), 16, 10).cast("bigint")
    whole_rows = docs.select(ident.alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), position.alias("pos"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = materialise(whole_rows.select("doc_id", "source", "size", "pos"), "sizes")
    targets = materialise(source_targets(rows, weights, share, repeats), "targets")
    # whole copies that every document of a source gives, and the budget for one more
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = targets.withColumn("base", whole).select("source", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"), F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("below"))
    for k in range(1, LEVELS + 1):
        state = materialise(_refine(rows, state, k), f"cut{k}")
    cuts = state.select(F.col("source").alias("of"), "source_size", "target", "base", "cut")
    copies = F.col("base") + (F.col("pos") < F.col("cut")).cast("bigint")
    rows = whole_rows if carry else rows
    return rows.join(cuts, rows["source"].eqNullSafe(cuts["of"])).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", *[f"carry_{c}" for c in carry])


def _refine(rows: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """``state`` with 12 more bits of each source's threshold; ``below``: what lies below it."""
    last = k == LEVELS
    shift = (LEVELS - k) * BITS
    bucket = F.shiftright(F.col("pos"), shift)
    marks = state.where("budget > 0").select(F.col("source").alias("of"), "cut", "below", "budget")
    inside = rows.select("source", "size", bucket.alias("bucket"))
    if k > 1:
        inside = inside.join(marks.select("of", "cut"), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright(F.col("bucket"), BITS) == F.col("cut"))).drop("of", "cut")
    sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("sum").over(running)).join(marks, F.col("source").eqNullSafe(F.col("of"))).withColumn("upto", F.col("upto") + F.col("below"))
    found = sums.where(F.col("upto") >= F.col("budget")).groupBy("of").agg(F.min(F.struct("bucket", "upto", (F.col("upto") - F.col("sum")).alias("under"))).alias("hit"))
    cut, under = F.col("hit.bucket"), F.col("hit.under")
    if last:  # the boundary itself goes in when that is nearer to the budget
        cut = cut + (F.col("hit.upto") - F.col("budget") < F.col("budget") - under).cast("bigint")
    joined = state.join(found, state["source"].eqNullSafe(found["of"]), "left")
    return joined.select("source", "source_size", "target", "base", "budget", F.coalesce(cut, F.lit(0)).alias("cut"), F.coalesce(under, F.lit(0)).alias("below"))
