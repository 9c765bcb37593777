"""The queries of this subpackage, each over its whole table, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pellucid.llm.ann import nearest
from pellucid.llm.chunked_bpe import chunked_bpe
from pellucid.llm.filter_audit import filter_audit
from pellucid.llm.imatch import fingerprints
from pellucid.llm.mixing import mix_sources
from pellucid.llm.ngram_join import ngram_join
from pellucid.llm.packing import pack_documents
from pellucid.llm.secrets import scan_secrets
from pellucid.llm.sharding import minimax_shards
from pellucid.llm.spelling import spelling_groups
from pellucid.llm.token_files import token_files
from pellucid.llm.toxicity import score_toxicity
from pellucid.llm.warc import warc_pages


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), count_links=True)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Every order of the five filters, and each step of it, over masks of failed filters.
_FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, unnest([1, 2, 3, 4, 5]) AS step, fails, n, good, bad FROM g, o),
t AS (SELECT *, fails[ascii(filter_order[step]) - 64] AS here, len(list_filter(fails, lambda x: x)) AS n_fails,
    len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND fails[ascii(x) - 64])) > 0 AS gone FROM s)
SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND here THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN here AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND here THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(CASE WHEN here THEN n * (120 // n_fails) ELSE 0 END) AS BIGINT) AS shapley
FROM t GROUP BY part, filter_order, step
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_filter_audit": _FILTER_AUDIT}
