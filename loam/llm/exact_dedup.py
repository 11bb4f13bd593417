"""Exact deduplication by a heavy-hitter split (built-in SQL functions only).

A Misra-Gries summary (Spark's ``approx_top_k``) finds the digests that are frequent. Their exact
winners and group sizes come from an aggregate with map-side combining and are broadcast: at most
``heavy`` rows, whatever the input. Rows of these digests are settled where they are read, without
a shuffle; all other digests, each at most a small share of the rows, are shuffled and windowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, without_spaces


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 4096, tracked: int = 65536) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_code_points``.

    Texts are equal when they are identical without spaces (U+0020, U+0009 to U+000D); a null text
    counts as empty, so null, empty and blank texts form one group. The row with the most code
    points stays, then the smallest id, null ids last; of rows equal in both, exactly one stays.
    ``heavy`` bounds the broadcast rows, ``tracked`` the summary. An empty table gives no rows;
    other columns are ignored, whatever their names. Texts are compared by SHA-256.
    """
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("size"),
            F.unhex(F.sha2(without_spaces(text), 256)).alias("digest"),
        ),
        "digests",
    )
    best = F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"))
    # one row with at most `heavy` 64-bit hashes
    top = rows.select(F.xxhash64("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {heavy}, {tracked})").alias("top")).select(F.explode("top").alias("t")).where("t.count > 1").select("t.item").collect()
    winners = (
        rows.where(F.xxhash64("digest").isin([x[0] for x in top]))
        .groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    split = rows.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    rest = split.where(F.col("best").isNull()).withColumns({"best": F.min(best).over(same), "group_size": F.count(F.lit(1)).over(same)})
    return split.where(F.col("best").isNotNull()).unionByName(rest).select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("size").alias("n_code_points"),
    )
