"""A corpus pipeline of five of the training-data operators.

Each stage takes all that its predecessor kept. ``run`` writes what a stage returns to the shared
folder and reads it again for the next one, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontaminate, lang_id, mixing, ngram_jaccard, token_store
from loam.llm.common import discard, discard_since, fresh, materialise, table, written
from loam.llm.queries import tokenizer_path

#: Ids of dropped documents that are broadcast (8 bytes each); with more, documents and ids are shuffled.
MOST_BROADCAST = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Those without letters, and those that score below the
    calibrated floor, go; so does nothing if no language can be learned."""
    model = lang_id.train(docs)
    if model is None:
        return docs
    return lang_id.keep_recognised(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked, directly or over others, by 5-word shingles at a Jaccard similarity of 0.75, the
    one with the smallest id; null ids come after all others, and of equal ids one row stays. Rows are
    told apart by a number of their own, so equal ids of unlike texts all stay. Rows without words
    (null, empty and blank texts) link with nothing and stay. An empty table stays empty."""
    row = fresh(docs.columns, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngram_jaccard.ngram_jaccard(numbered, row_id=row)
    gone = materialise(found.where(F.col("row") != F.col("keep_row")).select(F.col("row").alias(row)), "gone")
    few = gone.count() <= MOST_BROADCAST
    return numbered.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 10 or more words that benchmark items share; documents that are mostly
    such passages go."""
    cleaned = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times. Rows that share an id share a position and
    are taken together; null sources are a source, null and empty texts have no words. An empty table
    stays empty."""
    mixed, copy = mixing.mix(docs, carry=tuple(docs.columns)), fresh(docs.columns, "copy")
    copies = mixed.select(*[F.col(f"carry_{c}").alias(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias(copy))
    return copies.drop(copy)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in a content-addressed store, as read back from it."""
    return token_store.token_store(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: The first two stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written goes when its result stands."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = written()
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard_since(mark, docs)
        discard(last)
        last = docs
    return docs
