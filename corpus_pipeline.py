"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. ``run`` writes every stage's result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import chunks, mixing, ngrams, packing, quality
from tidegauge.llm.common import WORD, cut, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No stage that fits a model or packs by search can be written in SQL.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches one half.

    The score depends on the text alone, so equal texts fare alike; null and empty texts are scored like very
    short ones. Rows stay as they are, repeated ones, too; no rows give no rows; other columns go.
    """
    return quality.score(docs.select(*COLUMNS)).filter("keep").select(*COLUMNS)


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` and h, which tells rows with the same doc_id apart by their text."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are at least 0.8 alike: that of the smallest id, null after all others. Of rows with the same id and text one stays.

    Rows are told apart by a 64-bit key of id and text, so rows that share an id, or have none, link on their own.
    Texts without words link with nothing and stay, once for each id. No rows give no rows; other columns go.
    """
    small_batches(spark)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.select(*COLUMNS, key.alias("key"))
    found = ngrams.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), words=5, num=80, den=100)
    rows = found.groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count("*").alias("rows"))
    ids = keyed.select("key", "doc_id").distinct()
    first = rows.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "rows")).alias("x")).select(F.col("x.key").alias("first_key"), F.col("x.rows").alias("rows"))
    kept = keyed.join(first, F.col("key") == F.col("first_key"))
    once = kept.filter("rows = 1").select(*COLUMNS)
    return once.unionByName(kept.filter("rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids hold; what has no word left goes.

    Rows of one id take nothing from one another, and null ids come after all others and count as one. Texts
    that lost nothing stay as they are, null and empty ones, too. No rows give no rows; other columns go.
    """
    small_batches(spark)
    cut_ones = chunks.remove_passages(docs).filter("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("h"), "kept_text").dropDuplicates(["cut_id", "h"])
    rows = _hashed(docs).join(cut_ones.withColumnRenamed("h", "cut_h"), F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("h") == F.col("cut_h")), "left")
    rows = rows.filter(F.col("kept_text").isNull() | F.col("kept_text").rlike(WORD))
    n_chars = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return rows.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again where its source's share asks for it: half as many words more, by weight, at most twice each.

    Rows of equal id and text are one document here; a document with null or empty text or without words stays
    once. Ties in the mixing order are between documents of equal hash and are broken by id and size. A null
    source is a source. No rows give no rows; other columns go.
    """
    mixed = mixing.mix(_hashed(docs), weights=(5, 2, 1), share=1.5, cap=2.0, floor=1.0, keep=("h",))
    times = F.greatest(F.lit(1), F.round(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1)).cast("int"))
    # Texts stay out of the mixing: a row's number of copies is joined to it at the end.
    copies = mixed.groupBy(F.col("doc_id").alias("mixed_id"), F.col("h").alias("mixed_h")).agg(F.sum(times).alias("times"))
    rows = _hashed(docs).dropDuplicates(["doc_id", "h"]).join(copies, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & (F.col("h") == F.col("mixed_h")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048: a row a piece.

    Null and empty texts are a piece of one token. Repeated rows are packed each; no rows give no rows.
    """
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("quality", classify), ("near duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
