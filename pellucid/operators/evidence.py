"""Where in a text its evidence lies: segments of long texts (T08), places of signals (S24), and the fragments of a
reassembled text that they come from (P14).

Phrases are found in Arrow batches by one automaton over the catalogue, which is a constant; everything behind it is
joins and aggregates on the keys of the given rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pellucid.functions.catalog import RULES, Rule, tokens
from pellucid.functions.phrases import PhraseFinder, mapping_reliable
from pellucid.functions.segments import segment_spans
from pellucid.functions.unicode import FEW_TEXTS

# Candidates, and fragments, that one decision may map to.
MOST_CANDIDATES, MOST_FRAGMENTS = 4, 4
# End of the fixed values.


def _carried(batch: pa.RecordBatch, keys: list[str], rows: list[int]) -> list[pa.Array]:
    at = pa.array(rows, pa.int64())
    return [batch.column(k).take(at) for k in keys]


def few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, no more than ``FEW_TEXTS`` at a time: what Python makes of a batch grows with its texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW_TEXTS):
            yield batch.slice(at, FEW_TEXTS)


def _ddl(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + more


def segments(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The keys with ``segment`` (from 0), ``start``, ``stop`` and the segment's ``text``; places in code points.

    No segment is longer than the limit. A missing text has no segment, an empty one an empty segment.
    """

    def run(batches):
        for batch in few(batches):
            rows, out = [], []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                for n, (start, stop) in enumerate(segment_spans(text) if text is not None else ()):
                    rows.append(k)
                    out.append((n, start, stop, text[start:stop]))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*_carried(batch, keys, rows), *columns], names=[*keys, "segment", "start", "stop", "text"])

    return docs.select(*keys, text_col).mapInArrow(run, _ddl(docs, keys, "segment int, start long, stop long, text string"))


def phrase_table(spark: SparkSession, rules: list[Rule]) -> tuple[list[str], DataFrame]:
    """The distinct phrases of the rules, and who asks for them: number of the phrase, rule, kind, signal and place among its alternatives."""
    rows, numbers = [], {}
    for order, rule in enumerate(rules):
        for kind in ("required", "optional", "forbidden"):
            for signal, phrases in rule.of(kind):
                for place, phrase in enumerate(phrases):
                    rows.append((numbers.setdefault(tokens(phrase), len(numbers)), order, rule.rule_id, rule.action_group, rule.primary, len(rule.of("required")), kind, signal, place))
    return list(numbers), spark.createDataFrame(rows, "phrase int, ord int, rule_id string, action_group string, is_primary boolean, n_required int, kind string, signal_id string, place int")


def phrase_places(texts: DataFrame, keys: list[str], phrases: list[str], text_col: str = "text") -> DataFrame:
    """The keys with ``phrase`` (its number), ``start`` and ``stop`` of each occurrence in the text, and ``reliable``."""

    def run(batches):
        finder = PhraseFinder(phrases)
        for batch in few(batches):
            rows, out = [], []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                if found := list(finder.hits(text or "")):
                    reliable = mapping_reliable(text)
                    rows += [k] * len(found)
                    out += [(*hit, reliable) for hit in found]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*_carried(batch, keys, rows), *columns], names=[*keys, "phrase", "start", "stop", "reliable"])

    return texts.select(*keys, text_col).mapInArrow(run, _ddl(texts, keys, "phrase int, start long, stop long, reliable boolean"))


def rule_evidence(texts: DataFrame, keys: list[str], text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The keys with each rule that holds: all required signals, no forbidden one.

    The keys may hold arrays. ``signals`` lists the required ones with the place of the first alternative, in the catalogue's order, that occurs,
    at its first occurrence; ``reliable`` tells whether these places may be mapped to what the text was made of.
    """
    names, asked = phrase_table(texts.sparkSession, rules)
    hits = phrase_places(texts, keys, names, text_col).groupBy(*keys, "phrase", "reliable").agg(F.min(F.struct("start", "stop")).alias("first"))
    hits = hits.join(F.broadcast(asked), "phrase")  # the catalogue: a constant
    by_signal = hits.groupBy(*keys, "reliable", "ord", "rule_id", "action_group", "is_primary", "n_required", "kind", "signal_id").agg(F.min(F.struct("place", "first")).alias("chosen"))
    required = F.when(F.col("kind") == "required", F.struct(F.col("chosen.first.start").alias("start"), F.col("chosen.first.stop").alias("stop"), "signal_id"))
    by_rule = by_signal.groupBy(*keys, "reliable", "ord", "rule_id", "action_group", "is_primary", "n_required").agg(
        F.array_sort(F.collect_list(required)).alias("signals"), F.array_sort(F.collect_list(F.when(F.col("kind") == "optional", F.col("signal_id")))).alias("supporting"),
        F.max((F.col("kind") == "forbidden").cast("int")).alias("forbidden"),
    )
    return by_rule.where((F.size("signals") == F.col("n_required")) & (F.col("forbidden") == 0)).drop("forbidden", "n_required")


def segment_evidence(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rules that hold in a segment of a text: how many segments, and how many distinct places their signals have.

    ``first`` is the earliest place. What windows share counts once, as places are those of the whole text.
    """
    parts = segments(docs, keys, text_col).withColumn("origin", F.col("start")).drop("start", "stop")
    found = rule_evidence(parts, [*keys, "segment", "origin"])
    places = found.select(*keys, "segment", "rule_id", F.explode("signals").alias("s"), "origin")
    places = places.select(*keys, "segment", "rule_id", "s.signal_id", (F.col("s.start") + F.col("origin")).alias("start"))
    return places.groupBy(*keys, "rule_id").agg(F.countDistinct("segment").alias("n_segments"), F.countDistinct("signal_id", "start").alias("n_places"), F.min("start").alias("first"))


def contributions(evidence: DataFrame) -> DataFrame:
    """Evidence mapped to the fragments it overlaps; its rows carry ``spans``, each with ``candidate``, ``fragment``, ``lo`` and ``hi``.

    A rule is ``mapped`` if its places are reliable, each required signal overlaps a fragment, and no more than four
    candidates (``contributing``) and four fragments take part; the counts are zero otherwise. ``split_signal``: a signal lies
    across candidates. Signals and fragments of one text are few, so they meet in its row.
    """
    met = "filter(spans, s -> g.start < s.hi AND g.stop > s.lo)"
    rows = evidence.withColumn("met", F.expr(f"transform(signals, g -> struct(array_distinct({met}.candidate) AS candidates, array_distinct({met}.fragment) AS fragments))"))
    rows = rows.withColumn("contributing", F.array_sort(F.array_distinct(F.flatten("met.candidates"))))
    rows = rows.withColumns({"all_candidates": F.size("contributing"), "all_fragments": F.size(F.array_distinct(F.flatten("met.fragments")))})
    within = (F.col("all_candidates") <= MOST_CANDIDATES) & (F.col("all_fragments") <= MOST_FRAGMENTS)
    rows = rows.withColumn("mapped", F.col("reliable") & within & F.forall("met", lambda m: F.size(m["candidates"]) > 0))
    held = lambda c: F.when(F.col("mapped"), F.col(c)).otherwise(0).cast("long")
    rows = rows.withColumns({"n_candidates": held("all_candidates"), "n_fragments": held("all_fragments"), "split_signal": F.col("mapped") & F.exists("met", lambda m: F.size(m["candidates"]) > 1)})
    return rows.drop("met", "all_candidates", "all_fragments")


#: Where a fragment stands, or what it lacks: columns that regions may have beside their texts.
CONTEXTS = ("code", "quote", "in_list", "navigation", "partial")


def reassembled(regions: DataFrame, longest: int = 4_096, per_region: int = 48) -> DataFrame:
    """Windows of two to four neighbouring fragments of a region, put together in up to three ways.

    ``regions``: ``conv_id``, ``run``, ``chunk``, ``turn``, ``source_type``, ``text``. Path 1 joins fragments as their edges ask,
    path 2 by one space, path 3 by nothing where every joint is inside a word. Of equal texts of a window the
    first path stays. ``spans`` has each fragment's place: ``candidate``, ``fragment``, ``lo``, ``hi``. Of each of ``CONTEXTS``
    that regions have, ``any_`` and ``all_`` tell whether it holds for some or for all fragments (P12).
    """
    known = [c for c in CONTEXTS if c in regions.columns]
    key = ["conv_id", "run", "chunk", "turn", "source_type", "size"]
    ahead = Window.partitionBy("conv_id", "run", "chunk").orderBy("turn").rowsBetween(0, 3)
    rows = regions.withColumn("parts", F.collect_list(F.struct("turn", "text", *known)).over(ahead)).where(F.size("parts") > 1)
    rows = rows.select("conv_id", "run", "chunk", "turn", "source_type", "parts", F.explode(F.sequence(F.lit(2), F.size("parts"))).alias("size"))
    rows = rows.withColumn("parts", F.slice("parts", F.lit(1), F.col("size"))).where(F.aggregate("parts", F.lit(0), lambda n, p: n + F.length(p["text"])) <= longest)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "run", "chunk").orderBy("turn", "size"))).where(F.col("k") <= per_region)
    trimmed = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    joints = F.expr("transform(sequence(1, size - 1), i -> struct(parts[i - 1].text AS left, parts[i].text AS right))")
    open_edge = lambda j: F.regexp_like(j["left"], F.lit(r"(?U)\s$")) | F.regexp_like(j["right"], F.lit(r"(?U)^\s"))
    tight = lambda j: open_edge(j) | F.regexp_like(j["left"], F.lit(r"[(\[{«'\"\-]$")) | F.regexp_like(j["right"], F.lit(r"^[,.;:!?\])}»'\"\-]"))
    inside = lambda j: ~open_edge(j) & F.regexp_like(j["left"], F.lit(r"[\p{L}\p{N}]$")) & F.regexp_like(j["right"], F.lit(r"^[\p{L}\p{N}]"))
    rows = rows.withColumn("joints", joints).withColumn("compact", F.forall("joints", inside)).select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("path"))
    separators = F.concat(F.array(F.lit("")), F.transform("joints", lambda j: F.when(F.col("path") == 2, " ").when(F.col("path") == 3, "").when(tight(j), "").otherwise(" ")))
    rows = rows.where("path < 3 OR compact").withColumns({"separators": separators, "texts": F.transform("parts", lambda p: F.when(F.col("path") == 1, p["text"]).otherwise(trimmed(p["text"])))})
    rows = rows.withColumn("text", F.array_join(F.zip_with("separators", "texts", lambda s, t: F.concat(s, t)), "")).where("text <> ''")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "text").orderBy("path"))).where("nth = 1")
    ends = F.expr("transform(sequence(1, size), i -> aggregate(slice(separators, 1, i), 0, (n, s) -> n + length(s)) + aggregate(slice(texts, 1, i), 0, (n, t) -> n + length(t)))")
    rows = rows.withColumn("ends", ends)
    spans = F.expr("transform(sequence(0, size - 1), i -> struct(parts[i].turn AS candidate, parts[i].turn AS fragment, ends[i] - length(texts[i]) AS lo, ends[i] AS hi))")
    told = [F.expr(f"{f}(parts, p -> coalesce(p.{c}, false))").alias(f"{name}_{c}") for c in known for name, f in (("any", "exists"), ("all", "forall"))]
    return rows.select(*key, "path", "text", *told, spans.alias("spans"), F.col("parts")[F.col("size") - 1]["turn"].alias("last_turn"))


# How sure a decision is.
INSUFFICIENT, WEAK, MODERATE, STRONG = range(4)
# End of the fixed values.


@dataclass(frozen=True)
class Policy:
    """Which decisions count: from what confidence, put together in which ways, and whether attributes do."""

    minimum: int = MODERATE
    paths: tuple[int, ...] = (1, 2)
    attributes: bool = False


def minimum_confidence(threshold: float) -> int:
    """The confidence that a threshold between 0 and 1 asks for."""
    return WEAK if threshold <= 0.33 else MODERATE if threshold <= 0.66 else STRONG


def eligible(policy: Policy) -> F.Column:
    """Whether a decision counts (P17); below a weak confidence none does."""
    source = F.lit(True) if policy.attributes else F.col("source_type") == "text"
    return source & F.col("path").isin(*policy.paths) & (F.col("confidence") >= max(policy.minimum, WEAK)) & F.col("mapped") & (F.col("n_candidates") >= 2) & ~F.col("standalone")


def _confidence(contexts: dict[str, F.Column]) -> F.Column:
    """Complete chains of text are strong; attributes, compact texts, lists and menus cap, code and quotes forbid."""
    text, none = F.col("source_type") == "text", F.lit(False)
    get = lambda name: contexts.get(name, none)
    found = F.when(~F.col("mapped") | F.col("standalone") | (F.col("n_candidates") < 2) | get("code") | get("quote"), INSUFFICIENT)
    found = found.when(~text | (F.col("path") == 3) | get("navigation") | get("in_list"), WEAK)
    return found.when((F.col("path") == 1) & ~get("partial") & (F.col("n_candidates") == F.col("size")) & (F.col("size") <= 3), STRONG).otherwise(MODERATE)


def split_decisions(regions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What reassembled windows say that no fragment says alone: one row per window, path and action group.

    With the mapping to fragments (P14), whether a fragment alone holds the same group (P15), the confidence
    (P16) and whether the decision counts under the policy (P17).
    """
    windows = reassembled(regions)
    contexts = [c for c in windows.columns if c.startswith(("any_", "all_"))]
    key = ["conv_id", "run", "chunk", "turn", "last_turn", "source_type", "size", "path", *contexts]
    found = rule_evidence(windows, [*key, "spans"]).where("is_primary")
    first = Window.partitionBy(*key, "action_group").orderBy("ord")
    told = contributions(found.withColumn("nth", F.row_number().over(first)).where("nth = 1"))
    alone = rule_evidence(regions, ["conv_id", "run", "chunk", "turn"]).where("is_primary")
    alone = alone.select("conv_id", "run", "chunk", "action_group", F.col("turn").alias("own_turn"))
    rows = told.join(alone, ["conv_id", "run", "chunk", "action_group"], "left")
    inside = F.coalesce(F.col("own_turn").between(F.col("turn"), F.col("last_turn")), F.lit(False))
    rows = rows.groupBy(*key, "spans", "rule_id", "ord", "action_group", "supporting", "mapped", "n_candidates", "contributing", "split_signal").agg(F.max(inside).alias("standalone"))
    rows = rows.withColumn("confidence", _confidence({c[4:]: F.col(c) for c in contexts if c.startswith("any_")}).cast("long"))
    # complete primary constructions are strong evidence; of their impacts only one makes a high severity
    severity = F.when(F.col("rule_id").startswith("sensitive-disclosure.") & F.array_contains("supporting", "external-transfer"), 3).otherwise(2)
    return rows.withColumns({"severity": severity.cast("long"), "eligible": eligible(policy)}).drop("supporting")
