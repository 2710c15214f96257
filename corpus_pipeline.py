"""The corpus pipeline: five operators applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Rows are
known by a 128-bit digest of doc_id and text, in a column whose name no column of documents has.

Defined cases: repeated and null ids are told apart by their texts; rows equal in both share their fate, and of those that
the Jaccard join keeps one stays. Null and empty texts hold no letters, so language ID drops them. Of a class of near copies the
smallest doc_id stays (a null id only if all are null; ties go to the smallest digest). Empty tables give empty results. A text
without secrets or tokens is kept as it is. Extra columns, whatever their names, pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwright.llm import byte_bpe, decontaminate, jaccard_join, language_id, secret_scan
from mendwright.llm.common import free_name, table, written

#: Up to so many row keys are sent to all executors; more are joined by a shuffle, with the same result.
MOST_SENT = 1_000_000


def _key() -> Column:
    told = [F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c).cast("string"))) for c in ("doc_id", "text")]
    return F.md5(F.concat_ws("\x00", *told).cast("binary"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    key = free_name(docs, "row_key")
    return docs.withColumn(key, _key()), key


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in the one column of ``keys``."""
    own, key = _keyed(docs)
    keys = written(keys.toDF(key).distinct())
    if keys.count() <= MOST_SENT:
        keys = F.broadcast(keys)
    return own.join(keys, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with enough certainty."""
    own, key = _keyed(docs)
    nothing = F.lit(None).cast("string")
    found = language_id.identify(own, key, "text", F.col("lang"), F.col("source"), F.lit(""), nothing)
    return _without(docs, found.where("rejected").select(key))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class of near copies; of equal rows one."""
    own, key = _keyed(docs)
    found = jaccard_join.classes(own, id_col=key).select(F.col("doc_id").alias("row"), "component_id").distinct()
    ids = own.groupBy(F.col(key).alias("row")).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    members = written(found.join(ids, "row"))
    # only classes and rows that lose something go on: each class has one row to keep, known by its own key
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    left = _without(docs, members.join(first, "row", "left_anti").select("row"))
    again = members.where("rows > 1").join(first, "row", "left_semi").select("row")
    if again.isEmpty():
        return left
    own, key = _keyed(left)
    repeated = own.join(again.withColumnRenamed("row", key), key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return _without(left, again).unionByName(repeated)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer."""
    own, key = _keyed(docs)
    leaks = decontaminate.find_leaks(own, table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(docs, leaks.select("doc_id"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets masked."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as counts and digests, of each document."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

#: Similarity joins, language models and BPE go beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
