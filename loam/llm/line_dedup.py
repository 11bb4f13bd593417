"""Repeated runs of lines, by winnowing over line hashes (built-in SQL functions only).

A run repeats if it has ``run`` lines, or fewer with ``long_words`` words together. Such a run holds a
window: ``run`` adjacent lines, or fewer with so many words. The smallest line hash of each window
(the first of equal ones) is its fingerprint; equal windows have it at the same place, so no repeat
can be missed. Only the places of fingerprints are kept, each with the windows that chose it, which
reach from it both ways. Fingerprints that stand at one place only go, after a count that is combined
before the shuffle. The others are joined: a fingerprint's windows are compared, by two 64-bit
hashes, with the first place of the same lines, and a match is extended by the windows that overlap
it, so that whole runs go. All places are compared with the first one, never with each other: only
counts and first places are gathered by key. Joins are sorted merges at every size; Spark splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise



def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, long_words: int = 50) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, text`` (null text: empty, one blank line).

    Lines end at U+000A and are compared without spaces (U+0020, U+0009 to U+000D) at their ends;
    blank lines are skipped in runs and always stay. A line goes if it lies in a run of adjacent lines
    of its document that stood earlier, in a document of smaller id or further up, and has at least
    ``run`` lines or at least ``long_words`` words: the first place stays. Null ids come last; rows
    with one id are ordered by text, and identical rows count as one document with one result. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    line = lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), (x == "").alias("blank"))
    lines = F.filter(F.transform(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(SPACES))), line), lambda x: ~x["blank"])

    def windows(place):
        """The windows around a place whose first smallest line hash it has."""
        at = lambda j, what: F.get("lines", place + j)[what]
        found = []
        for k in range(1, run + 1):
            for begin in range(1 - k, 1):
                inside = range(begin, begin + k)
                chosen = at(begin, "h").isNotNull() & at(begin + k - 1, "h").isNotNull()
                if k < run:
                    chosen &= sum((at(j, "n") for j in inside), F.lit(0)) >= long_words
                for j in inside:
                    if j:
                        chosen &= at(j, "h") > at(0, "h") if j < 0 else at(j, "h") >= at(0, "h")
                found.append(F.when(chosen, F.struct(F.array(*[at(j, "at") for j in inside]).alias("ats"), F.xxhash64(*[at(j, "h") for j in inside]).alias("gram"), F.xxhash64(*[at(j, "g") for j in inside]).alias("gram2"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    prints = F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.struct(F.get("lines", i)["h"].alias("low"), windows(i).alias("windows")))
    prints = F.filter(prints, lambda x: F.size(x["windows"]) > 0)
    spots = whole.select("doc_id", "th", lines.alias("lines")).where(F.size("lines") > 0).select("doc_id", "th", F.explode(prints).alias("p")).select("doc_id", "th", "p.*")
    spots = materialise(spots, "prints")
    repeated = materialise(spots.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low"), "repeated")
    found = spots.join(repeated.hint("merge"), "low", "left_semi").select("doc_id", "th", F.explode("windows").alias("w")).select("doc_id", "th", "w.*", F.size("w.ats").alias("k"))
    found = materialise(found, "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", F.col("ats")[0].alias("at"))
    alike = ["gram", "gram2", "k"]
    first = materialise(found.groupBy(*alike).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    later = found.join(first.hint("merge"), alike).where(place > F.col("first"))
    gone = later.select("doc_id", "th", F.explode("ats").alias("at")).groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"))
    gone = gone.withColumnRenamed("doc_id", "of").withColumnRenamed("th", "of_th")
    joined = whole.join(gone.hint("merge"), whole["doc_id"].eqNullSafe(gone["of"]) & (whole["th"] == gone["of_th"]), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, text`` (null text: empty).

    Words are runs of other characters than U+0020 and U+0009 to U+000D and go with the spaces after
    them. A word goes if it lies in a window of ``words`` words of its document whose words stood
    earlier, in a document of smaller id or further up, wherever lines end: the first place stays.
    Ids, repeated rows and other columns are taken as by ``line_dedup``.

    Windows are winnowed: of the hashes of half as long runs of words in a window, the smallest is its
    fingerprint, which equal windows have at the same place. Only windows around fingerprints that
    occur again are made and compared by two 64-bit hashes.
    """
    part = (words + 1) // 2
    grams = words - part + 1  # runs of ``part`` words in a window
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    hashed = whole.select("doc_id", "th", F.transform(pieces, lambda x: F.xxhash64(F.rtrim(x, F.lit(SPACES)))).alias("words"))
    hashed = hashed.withColumn("n", F.size("words")).where(F.col("n") >= words).dropDuplicates(["doc_id", "th"])
    hashed = materialise(hashed, "words")
    starts = lambda last: F.sequence(F.lit(0), last)
    runs = hashed.select("doc_id", "th", "n", F.transform(starts(F.col("n") - part), lambda i: F.struct(F.xxhash64(F.slice("words", i + 1, F.lit(part))).alias("low"), i.alias("at"))).alias("runs"))
    minima = F.array_distinct(F.transform(starts(F.col("n") - words), lambda i: F.array_min(F.slice("runs", i + 1, F.lit(grams)))))
    prints = materialise(runs.select("doc_id", "th", F.explode(minima).alias("p")).select("doc_id", "th", "p.*"), "prints")
    repeated = prints.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low")
    found = prints.join(repeated, "low", "left_semi").groupBy("doc_id", "th").agg(F.collect_list("at").alias("found"))

    def of(frame: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = other.withColumnRenamed("doc_id", "of").withColumnRenamed("th", "of_th")
        return frame.join(other, frame["doc_id"].eqNullSafe(other["of"]) & (frame["th"] == other["of_th"]), how)

    around = F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(F.greatest(x - (grams - 1), F.lit(0)), F.least(x, F.col("n") - words)))))
    content = lambda i: F.slice("words", i + 1, F.lit(words))
    window = F.transform(around, lambda i: F.struct(i.alias("at"), F.xxhash64(content(i)).alias("gram"), F.xxhash64(F.lit(1), content(i)).alias("gram2")))
    windows = materialise(of(hashed, found, "inner").select("doc_id", "th", F.explode(window).alias("w")).select("doc_id", "th", "w.*"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "at")
    first = windows.groupBy("gram", "gram2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["gram", "gram2"]).where(place > F.col("first"))
    gone = later.groupBy("doc_id", "th").agg(F.collect_list("at").alias("starts"))
    removed = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x, x + (words - 1)))))
    split = of(whole, gone, "left").select("doc_id", "text", pieces.alias("pieces"), removed.alias("gone"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("gone")), lambda i: F.get("pieces", i))
    return split.select(
        "doc_id",
        F.size("pieces").cast("bigint").alias("n_words"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0), F.array_join(kept, ""))).alias("text"),
    )
