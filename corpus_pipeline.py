"""A training corpus from documents: each stage works on what the one before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. ``run`` applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pellucid.llm.chunked_bpe import chunked_bpe
from pellucid.llm.common import materialize
from pellucid.llm.mixing import mix_sources
from pellucid.llm.ngram_join import ngram_join
from pellucid.llm.registry import vocabulary
from pellucid.llm.secrets import redact_secrets
from pellucid.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; all others stay as they are."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, a hash of id, source and text, nulls told from all values; repeated rows share it."""
    named = [x for c in ("doc_id", "source") for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumn("_key", F.xxhash64(*named, F.xxhash64(F.coalesce("text", F.lit("")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest id, rows without an id coming last.

    Rows count by id, source and text, so that other texts under a repeated id stay. Documents without
    words are in no group and stay.
    """
    keyed = _keyed(docs)
    groups = ngram_join(keyed.select("_key", "text"), "_key").where("n_shingles > 0")
    groups = groups.groupBy("_key").agg(F.min("component_id").alias("group"), F.count(F.lit(1)).alias("repeats"))
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    groups = materialize(groups.join(ids, "_key"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first"))
    state = groups.join(first, "group").select("_key", (F.col("_key") == F.col("first._key")).alias("_first"), "repeats")
    state = materialize(state.where("NOT _first OR repeats > 1").select("_key", "_first"))
    rows = keyed.join(state, "_key", "left")
    once = rows.where("_first").groupBy("_key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return rows.where("_first IS NULL").select(docs.columns).unionByName(once.select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced in the texts; every document stays."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes its words: 0 to 3 times.

    A fraction of a copy becomes one with that probability, by a hash of the row (id, source, text and a
    number among repeats), so that sources keep their shares. Rows without an id take part like all others.
    Documents without words have nothing to be taken and go.
    """
    keyed = _keyed(docs)
    mix = mix_sources(keyed.select("_key", "text", "source"), "_key").where("size > 0")
    mix = mix.groupBy("_key").agg((F.sum("taken") / F.sum("size")).alias("_times"), F.count(F.lit(1)).alias("_repeats"))
    rows = keyed.join(mix, "_key")
    number = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*docs.columns)))
    rows = rows.where("_repeats = 1").withColumn("_number", F.lit(1)).unionByName(rows.where("_repeats > 1").withColumn("_number", number))
    uniform = F.pmod(F.xxhash64("_key", "_number", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("_copies", F.floor(F.col("_times") + uniform).cast("int")).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left: their number and digests, decoded text included."""
    return chunked_bpe(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The classifier and the encoder can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
