"""How filters over documents act together: what each removes in every order of application.

Four filters look at one text alone. The fifth asks for an identical text under a smaller id, anywhere in the
table: texts are dealt by ranges, whose bounds are the shortest prefixes that tell neighbouring texts apart, and
each range inserts its full texts into compressed tries with the least id at each terminal; traversing them gives
the flags. Copies that meet in one input task are settled there by such a trie as well, so a text that a third
of all rows share crosses the shuffle once for each block of a task. After that a document is a mask of
failed filters, and all orders are sums over the few distinct masks.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import materialize, shuffle_partitions, utf8
from pellucid.llm.radix_trie import RadixTrie, common_prefix

FILTERS = "ABCDE"
#: Bytes of text that a trie holds before it is traversed and dropped.
TRIE_BYTES = 1 << 24
#: Texts for each range from which bounds are chosen, and code points of them; they decide where a text is handled, never how.
RANGE_SAMPLE, SAMPLE_CHARS = 12, 2048
_NOT_CAPITAL = bytes(b for b in range(256) if not ord("A") <= b <= ord("Z"))
_NOT_MARK = bytes(b for b in range(256) if b not in b"#$%&*|")
_CONTINUES = bytes(range(0x80, 0xC0))
_ROWS = pa.schema([("bounds", pa.int32()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())])


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails; words lie between ASCII white space."""
    words = text.split()
    mask = 1 * (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
    mask += 4 * (100 * len(text.translate(None, _NOT_CAPITAL)) > 2 * len(text.translate(None, _CONTINUES)))
    return mask + 8 * bool(text.translate(None, _NOT_MARK))


def _bounds(texts: DataFrame, n: int) -> list[bytes]:
    """Up to n - 1 ascending prefixes that cut the texts into ranges of about equal numbers.

    They come from a bounded number of texts. Each bound is the shortest prefix of its text that the text
    before it does not reach, so bounds are short where texts differ early and long within families of copies.
    """
    if n < 2:
        return []
    total = texts.count()
    share = min(1.0, 1.5 * RANGE_SAMPLE * n / max(1, total))
    some = texts.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).sample(share, 17).limit(2 * RANGE_SAMPLE * n)
    found = sorted({r["text"].encode() for r in some.collect()})
    cuts = [k * len(found) // n for k in range(1, n)]
    return sorted({found[k][: common_prefix(found[k - 1], found[k]) + 1] for k in cuts if k})


def _settle(bounds: list[bytes]):
    """Masks of all rows; copies within a block of the task are settled, one row of each text goes on with it.

    Rows of one text, id, part and mask are counted together.
    """
    at_once = len(bounds) + 1

    def flush(trie: RadixTrie, turn: int):
        out = []
        for text, least, items in trie.terminals():
            counts: dict[tuple, int] = {}
            for item in items:
                counts[item] = counts.get(item, 0) + 1
            for (key, part, mask), n in counts.items():
                if key is not None and key > least:
                    turn += 1
                    out.append((turn % at_once, key, part, mask | 16, n, None))
                elif key is None:
                    turn += 1
                    out.append((turn % at_once, key, part, mask, n, None))
                else:
                    out.append((bisect_right(bounds, text), key, part, mask, n, text))
            if len(out) >= 512:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def run(batches):
        trie, held, turn = RadixTrie(), 0, 0
        for batch in batches:
            for key, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(text, key, (key, part, text_mask(text)))
                held += 200 + len(text)
                if held >= TRIE_BYTES:
                    yield from flush(trie, turn)
                    trie, held, turn = RadixTrie(), 0, turn + 1
        yield from flush(trie, turn)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)


def _flag(batches):
    """Rows in order of their texts; a trie is traversed and dropped where the next text differs, once it is full."""

    def flagged(trie: RadixTrie):
        out = [(key, part, mask | 16 * (key > least), n) for _, least, items in trie.terminals() for key, part, mask, n in items]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["id", "part", "mask", "n"])

    trie, held, before = RadixTrie(), 0, None
    for batch in batches:
        settled = batch.filter(batch.column("text").is_null())
        yield settled.select(["id", "part", "mask", "n"])
        for row in batch.filter(batch.column("text").is_valid()).to_pylist():
            if held >= TRIE_BYTES and row["text"] != before:
                yield from flagged(trie)
                trie, held = RadixTrie(), 0
            before = row["text"]
            trie.insert(before, row["id"], (row["id"], row["part"], row["mask"], row["n"]))
            held += 200 + len(before)
    yield from flagged(trie)


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, mask, n)``: how many rows of an id and part fail which filters (bits in the order of ``FILTERS``).

    A missing text is empty, a missing part an empty string. A row without an id is no copy of others and makes none;
    repeated rows of one id are no copies of each other.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), utf8(text_col).alias("text"))
    bounds = _bounds(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), n)
    settled = rows.mapInArrow(_settle(bounds), "bounds int, id long, part string, mask int, n long, text binary")
    dealt = settled.repartitionById(len(bounds) + 1, "bounds").sortWithinPartitions("text").select("id", "part", "mask", "n", "text")
    flagged = dealt.mapInArrow(_flag, "id long, part string, mask int, n long")
    return flagged.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from ``(part, mask, n, good, toxic)``, whose rows are few for each part.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, gone before), ``unique_fails`` (failing
    no other), ``good_lost`` and ``toxic_lost`` (of those removed) and ``shapley``: what the filter removes, summed over all
    orders. A document that fails k filters falls to each of them in one order of k.
    """
    orders = [F.struct(F.lit("".join(p)).alias("order"), F.array(*(F.lit(1 << filters.index(f)) for f in p)).alias("bits")) for p in permutations(filters)]
    rows = masks.select("*", F.explode(F.array(*orders)).alias("o")).select("part", "mask", "n", "good", "toxic", F.col("o.order").alias("filter_order"), F.posexplode("o.bits").alias("at", "bit"), F.col("o.bits").alias("bits"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a.bitwiseOR(b))
    rows = rows.withColumns({"earlier": F.col("mask").bitwiseAND(before) != 0, "fails": F.col("mask").bitwiseAND(F.col("bit")) != 0})
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    gone, here = F.col("earlier"), F.col("fails") & ~F.col("earlier")
    share = F.col("n") * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count("mask"), F.lit(1)))
    return rows.groupBy("part", "filter_order", (F.col("at") + 1).alias("step")).agg(
        total(~gone & ~F.col("fails")).alias("kept"), total(here).alias("removed"), total(gone & F.col("fails")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(F.col("fails"), share)), F.lit(0)).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interaction of the five filters in all 120 orders, for each part of the documents.

    A document is good or toxic if any row of ``labels`` under its id says so; labels without an id and documents
    without a label count as neither. Empty texts fail A; other columns are not read; no documents, no rows.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    rows = filter_masks(docs, id_col, text_col, part_col).join(known, "id", "left")
    counted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    masks = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("is_good").alias("good"), counted("is_toxic").alias("toxic"))
    return audit_orders(materialize(masks))
