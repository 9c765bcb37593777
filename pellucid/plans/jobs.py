"""Queries that SQL can't express: parsing, Unicode, and keyed state, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.functions import css, unicode
from pellucid.functions.dialect import Spark
from pellucid.operators import evidence, literals, stacking, styles
from pellucid.operators import regions as page_regions
from pellucid.operators.links import hosts
from pellucid.operators.requests import normalized
from pellucid.operators.splitting import regions
from pellucid.plans.shared import shared_folder
from pellucid.sources import dom, html
from pellucid.sources.seeds import CONTEXT_SEEDS, CSS_SEEDS, LITERAL_SEEDS, seeded_calls, seeded_docs, seeded_elements, seeded_requests
from pellucid.streaming import findings, requests


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    views = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables)
    return spark.sql(f"WITH {views} {text}")


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sql(spark, sf_dir, f"SELECT doc_id, text FROM {seeded_docs(Spark())} s", "documents")
    return docs.select("doc_id", F.sha2(unicode.normalized("text"), 256).alias("normalized_sha256"))


def word_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sql(spark, sf_dir, f"SELECT doc_id, text FROM {seeded_docs(Spark())} s", "documents")
    return docs.select("doc_id", unicode.word_count("text").alias("n_words"))


def punycode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sql(spark, sf_dir, f"SELECT host FROM {hosts(Spark())} h", "pages")
    return found.select("host", unicode.decoded_host("host").alias("decoded"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.elements(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("depth").alias("depth"), F.countDistinct("tag").alias("n_tags"))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.candidates(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "node_id", "postorder", "tag", "source", "region", F.length("own_text").alias("chars"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.rate_limited(_sql(spark, sf_dir, f"SELECT seq, request_id AS sender, now_ms FROM {seeded_requests(Spark())} e", "events"))


def serving_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.gated(_sql(spark, sf_dir, f"SELECT * FROM {seeded_calls(Spark())} c", "events"), [0, 1, 2, 3, 4, 5])


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table replayed as a stream; finished requests are appended to a table and read back."""
    run = uuid.uuid4().hex
    # a pattern that the table's own name alone meets: the source takes folders or patterns
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    view, out = f"request_stream_{run}", f"{shared_folder(spark)}/request-stream-{run}"
    events.createOrReplaceTempView(view)
    rows = spark.sql(f"WITH events AS (SELECT * FROM {view}) SELECT * FROM {normalized(Spark())} n")
    spark.catalog.dropTempView(view)
    query = requests.assemble(rows).writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(requests.OBSERVED).parquet(f"{out}/table")


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sql(spark, sf_dir, f"SELECT doc_id, text FROM {seeded_docs(Spark())} s", "documents")
    return evidence.segments(docs, ["doc_id"]).select("doc_id", F.col("segment").cast("long").alias("segment"), "start", "stop")


def segment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sql(spark, sf_dir, f"SELECT doc_id, text FROM {seeded_docs(Spark())} s", "documents")
    return evidence.segment_evidence(docs, ["doc_id"])


def signal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the required signals of rules that hold in whole texts; a long text is segmented, so its places are unreliable."""
    docs = _sql(spark, sf_dir, f"SELECT doc_id, text, length(text) <= 4096 AS whole FROM {seeded_docs(Spark())} s", "documents")
    rows = evidence.rule_evidence(docs, ["doc_id", "whole"])
    return rows.select("doc_id", "rule_id", (F.col("reliable") & F.col("whole")).alias("reliable"), F.explode("signals").alias("s")).select("doc_id", "rule_id", "reliable", "s.signal_id", "s.start", "s.stop")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.split_decisions(_sql(spark, sf_dir, f"SELECT * FROM {regions(Spark())} r", "conversations"))


def split_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir)
    return rows.select("conv_id", "turn", "size", "path", "rule_id", "mapped", "n_candidates", "split_signal", "standalone", "confidence", "eligible")


def context_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions where fragments stand in code, quotes, lists or menus, or lack something, under three policies."""
    where = ", ".join(f"{test} AS {name}" for name, test in CONTEXT_SEEDS.items())
    rows = evidence.split_decisions(_sql(spark, sf_dir, f"SELECT r.*, {where} FROM {regions(Spark())} r", "conversations"))
    policies = {"usual": evidence.Policy(), "strict": evidence.Policy(evidence.minimum_confidence(0.8)), "lenient": evidence.Policy(evidence.minimum_confidence(0.2), (1, 2, 3), True)}
    return rows.select("conv_id", "turn", "size", "path", "rule_id", "any_code", "any_in_list", "all_in_list", "confidence", *(evidence.eligible(p).alias(name) for name, p in policies.items()))


def merged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.merge_decisions(_decisions(spark, sf_dir))
    return rows.select("conv_id", "run", "chunk", "source_type", "action_group", "rule_id", "confidence", "severity", "path", F.array_join("candidates", ",").alias("candidates"), "n_decisions")


def finding_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's findings committed whole, then a region anew, then more of them in part, then some candidates removed."""
    return findings.revisions(findings.replayed(findings.merge_decisions(_decisions(spark, sf_dir))))


def _literals(spark: SparkSession, sf_dir: str) -> list[literals.Literal]:
    """A catalogue of some fixed items and the first three words of benchmark passages, as far as a catalogue goes."""
    passages = _sql(spark, sf_dir, "SELECT item_id, array_join(slice(split(text, ' '), 1, 3), ' ') AS source FROM benchmark WHERE text IS NOT NULL", "benchmark")
    rows = passages.orderBy("item_id").limit(2 * literals.MOST_LITERALS).collect()
    return literals.prepare_literals([*LITERAL_SEEDS, *((f"b{r['item_id']}", r["source"], True, "literal") for r in rows)])


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sql(spark, sf_dir, f"SELECT doc_id, in_code OR in_quote AS mitigated, text FROM {seeded_docs(Spark())} s", "documents")
    return evidence.segments(docs, ["doc_id", "mitigated"]).select("doc_id", "mitigated", F.col("segment").cast("long").alias("segment"), "text")


def literals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.literal_matches(_segmented(spark, sf_dir), ["doc_id", "segment"], _literals(spark, sf_dir)).select("doc_id", "segment", "literal_id", "place")


def literal_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches kept of each segment under a cap of two, and whether there were more."""
    found = literals.literal_matches(_segmented(spark, sf_dir), ["doc_id", "segment"], _literals(spark, sf_dir))
    return found.where("place <= 2").groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("kept"), F.max(F.col("n_found") > 2).alias("partial"))


def literal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.folded_groups(_segmented(spark, sf_dir), ["doc_id", "segment"], _literals(spark, sf_dir))


def owned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dom.phrase_candidates(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "node_id", "tag", "kind", "source", "code", "quote", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def split_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dom.split_candidates(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("chars", F.length("text")).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def link_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.captions(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def regions_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_regions.page_regions(dom.split_candidates(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def windows_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_regions.page_windows(dom.split_candidates(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def click_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT e.*, node_id % 2 = 0 OR is_input AS is_target, is_input AS is_critical FROM {seeded_elements(Spark())} e", "pages")
    return stacking.click_captures(rows)


def retracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are left when every eleventh element of a page, with all in it, is removed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    removed = dom.nodes(pages).where("tag IS NOT NULL AND node_id > 40 AND node_id % 11 = 0")
    return dom.retracted(dom.phrase_candidates(pages).select("page_id", "node_id", "kind", "source"), removed)


def change_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dom.nodes(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return dom.change_roots(rows.withColumn("changed", F.expr("tag IS NOT NULL AND (page_id + node_id) % 7 = 0 AND node_id > 20")))


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of pages with captured styles: planted ones by residue, else the style attribute."""
    rows = dom.nodes(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    planted = F.create_map(*(F.lit(x) for pair in CSS_SEEDS.items() for x in pair))
    style = F.coalesce(F.try_element_at(planted, F.expr("CAST((page_id * 7 + node_id * 5) % 43 AS INT)")), F.try_element_at("attributes", F.lit("style")))
    return rows.withColumn("style", F.when(F.col("tag").isNotNull() & ~F.col("tag").isin("html", "body", "head"), style))


def hiding_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.hiding(_styled(spark, sf_dir))


def hidden_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.hidden_containers(_styled(spark, sf_dir))


def backdrops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.backdrops(_styled(spark, sf_dir))


def obfuscations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.obfuscations(_styled(spark, sf_dir))


def style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, lengths and transforms that captured styles declare."""
    rows = _styled(spark, sf_dir).where("style IS NOT NULL")
    get = lambda name: css.declared(F.col("style"), name)
    return rows.select("page_id", "node_id", css.colour(get("background-color")).alias("ground"), css.colour(get("color")).alias("ink"), css.pixels(get("font-size")).alias("font_px"), css.pixels(get("width"), container=1280.0).alias("width_px"), css.smallest_scale(get("transform")).alias("scale"), css.far_translation(get("transform")).alias("far")).select("page_id", "node_id", F.col("ground.red").alias("ground_red"), F.col("ground.alpha").alias("ground_alpha"), F.col("ink.red").alias("ink_red"), "font_px", "width_px", "scale", "far")


QUERIES = {
    "s03_normalize": normalize,
    "s05_word_breaks": word_breaks,
    "l11_punycode": punycode,
    "t01_page_elements": page_elements,
    "t03_page_candidates": page_candidates,
    "g10_rate_limit": rate_limit,
    "g09_serving_gates": serving_gates,
    "a02_request_stream": request_stream,
    "t08_segments": text_segments,
    "t08_segment_findings": segment_findings,
    "s24_signal_places": signal_places,
    "t04_owned_texts": owned_texts,
    "t15_retracted": retracted_texts,
    "t16_change_roots": change_roots,
    "p06_page_regions": regions_of_pages,
    "p08_page_windows": windows_of_pages,
    "v04_hiding_elements": hiding_elements,
    "v06_hidden_containers": hidden_containers,
    "v15_style_values": style_values,
    "v16_backdrops": backdrops,
    "v30_obfuscations": obfuscations,
    "v25_click_captures": click_captures,
    "p02_split_fragments": split_fragments,
    "l02_link_captions": link_captions,
    "p14_contributions": split_contributions,
    "p16_context_decisions": context_decisions,
    "p19_merged_decisions": merged_decisions,
    "p20_finding_revisions": finding_revisions,
    "s09_literals": literals_found,
    "s22_literal_cap_kept": literal_caps,
    "s19_literal_groups": literal_groups,
}
