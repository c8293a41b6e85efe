"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are cut out, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm import byte_pairs, mixing, near_join, secret_scan, toxicity
from tonegrid.llm.common import bounded_batches, hex_digest, table, unused
from tonegrid.llm.queries import byte_ranks
from tonegrid.session import materialize, ship

#: Documents at least so likely to be toxic are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what a machine fitted on the labels calls toxic; empty and null texts stay unless the bias alone rejects."""
    ship(spark)
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), machine) < TOXIC)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that near-duplicate links join, keep the one of the smallest id.

    Documents without words are no copies of each other; equal rows are. Among equal ids the smallest hash stays.
    """
    ship(spark)
    groups = near_join.join(docs)
    row = F.struct(F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    linked = groups.where(F.col("_set").isNotNull()).groupBy("_set").agg(F.min(row).alias("_kept")).select("_kept.row")
    wordless = groups.where(F.col("_set").isNull()).select(F.col("_row").alias("row"))
    mark = unused(docs, "_kept_row")
    kept = linked.unionByName(wordless).distinct().withColumnRenamed("row", mark)
    marked = docs.withColumn(mark, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind; the character count follows the text. All documents stay."""
    ship(spark)
    formats = secret_scan.learn_formats(docs)
    clean = docs.withColumn("text", secret_scan.redact(F.col("text"), formats))
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until each source has its target weight of words."""
    ship(spark)
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number, their digest and that of the bytes they decode to."""
    ship(spark)
    ranks, pattern = byte_ranks()
    back = byte_pairs.round_trip(docs, ranks, pattern)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), hex_digest(F.array_join("ids", ",")).alias("ids_sha256"), hex_digest(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", bounded_batches(drop_toxic)),
    ("near_duplicates", bounded_batches(keep_one)),
    ("secrets", bounded_batches(cut_secrets)),
    ("mixing", bounded_batches(mix_sources)),
    ("encoding", bounded_batches(encode)),
]

#: Fitted scores, MinHash bands and token merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
