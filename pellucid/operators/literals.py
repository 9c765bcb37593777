"""A user's own literals in texts: prepared once, found by one automaton, folded into the built-in groups.

The catalogue is a setting of at most 500 literals, so it goes to all tasks with the plan. Each text is read once,
whatever the number of literals.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.functions.catalog import RULES
from pellucid.functions.phrases import JOIN, TOKEN, PhraseFinder, automaton, literal_hits, words_of
from pellucid.functions.unicode import normalize_text
from pellucid.operators.evidence import _carried, _ddl, few, rule_evidence
from pellucid.plans.shared import written

# Literals, and their characters, in a catalogue; graphemes of a short literal.
MOST_LITERALS, MOST_CHARACTERS, SHORT = 500, 65_536, 2
_EXACT = regex.compile(r"[*+?()\[\]{}|\\^$/]|\p{Extended_Pictographic}")
# End of the fixed values.


@dataclass(frozen=True)
class Literal:
    literal_id: str
    text: str
    #: Compared with the normalised text itself; otherwise with its words.
    exact: bool
    short: bool
    #: Groups of those primary rules all of whose required signals the literal itself holds.
    related: tuple[str, ...]


def related_groups(words: str) -> tuple[str, ...]:
    primary = [r for r in RULES if r.primary]
    holds = lambda phrases: any(True for _ in PhraseFinder(phrases).hits(words))
    return tuple(dict.fromkeys(r.action_group for r in primary if all(holds(phrases) for _, phrases in r.of("required"))))


def prepare_literals(items: Iterable[tuple], most: int = MOST_LITERALS, most_characters: int = MOST_CHARACTERS) -> list[Literal]:
    """The active literals among (id, source, enabled, mode), in their order.

    Items that are disabled, of another mode, without text or repeated are passed over; so is one that the
    characters left do not hold. The list ends where either bound is used up.
    """
    found, seen, characters = [], set(), 0
    for literal_id, source, enabled, mode in items:
        if len(found) >= most or characters >= most_characters:
            break
        if not enabled or mode != "literal" or not isinstance(literal_id, str) or not isinstance(source, str):
            continue
        whole = normalize_text(source)
        words = " ".join(TOKEN.findall(whole))
        exact = bool(_EXACT.search(whole)) or any(c in source for c in JOIN)
        text = whole if exact else words
        if not text or characters + len(text) > most_characters or (exact, text) in seen:
            continue
        seen.add((exact, text))
        characters += len(text)
        found.append(Literal(literal_id, text, exact, len(regex.findall(r"\X", text)) <= SHORT, related_groups(words)))
    return found


def literal_matches(texts: DataFrame, keys: list[str], literals: list[Literal], text_col: str = "text") -> DataFrame:
    """The keys with ``literal_id`` of each literal between word borders in the text, ``place`` among them and ``n_found``.

    Places follow the catalogue, from 1; a caller's cap keeps the first ones and calls a text with more partial.
    """
    exact, plain = ([k for k, x in enumerate(literals) if x.exact is kind] for kind in (True, False))

    def run(batches):
        by_text, by_words = (automaton([literals[k].text for k in own]) for own in (exact, plain))
        for batch in few(batches):
            rows, out = [], []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                whole = normalize_text(text)
                hits = [exact[n] for n in literal_hits(by_text, whole)]
                hits += [plain[n] for n in literal_hits(by_words, " ".join(words_of(whole)))]
                rows += [k] * len(hits)
                out += [(literals[n].literal_id, place, len(hits)) for place, n in enumerate(sorted(hits), 1)]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*_carried(batch, keys, rows), *columns], names=[*keys, "literal_id", "place", "n_found"])

    return texts.select(*keys, text_col).mapInArrow(run, _ddl(texts, keys, "literal_id string, place long, n_found long"))


def folded_groups(texts: DataFrame, keys: list[str], literals: list[Literal]) -> DataFrame:
    """One row per text and group of findings, from built-in primary rules and literals: lead rule and all literals with it.

    A literal joins a built-in group if it is related to that group alone and the text has the group; it is a group of
    its own otherwise. ``severity`` is that of groups led by a literal: low for short ones, and for others in code or
    quotes (``mitigated``), else medium; null where a built-in rule leads.
    """
    spark = texts.sparkSession
    # the catalogue: at most 500 rows
    told = spark.createDataFrame([(x.literal_id, x.related[0] if len(x.related) == 1 else None, x.short) for x in literals], "literal_id string, related string, short boolean")
    built_in = rule_evidence(texts, [*keys, "mitigated"]).where("is_primary").groupBy(*keys, "mitigated", "action_group").agg(F.min_by("rule_id", "ord").alias("rule_id"))
    # asked for twice, and phrases cost far more to find than their rows to write
    built_in = spark.read.parquet(written(built_in, "built-in"))
    own = literal_matches(texts, [*keys, "mitigated"], literals).join(F.broadcast(told), "literal_id")
    present = built_in.select(*keys, F.col("action_group").alias("related"), F.lit(True).alias("joins"))
    # a written table packs so well that its file size may call for a broadcast
    own = own.join(present.hint("merge"), [*keys, "related"], "left").withColumn("action_group", F.when(F.col("joins"), F.col("related")).otherwise(F.concat(F.lit("custom-pattern:"), "literal_id")))
    severity = F.when(F.col("short") | F.col("mitigated"), "low").otherwise("medium")
    rows = own.select(*keys, "action_group", F.lit(None).cast("string").alias("rule_id"), "literal_id", F.when(F.col("joins").isNull(), severity).alias("severity"))
    rows = rows.unionByName(built_in.select(*keys, "action_group", "rule_id", F.lit(None).cast("string").alias("literal_id"), F.lit(None).cast("string").alias("severity")))
    return rows.groupBy(*keys, "action_group").agg(
        F.coalesce(F.max("rule_id"), F.col("action_group")).alias("rule_id"), F.array_join(F.array_sort(F.collect_set("literal_id")), ",").alias("literals"), F.max("severity").alias("severity"),
    )
