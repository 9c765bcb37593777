"""I-Match document fingerprints with several randomised lexicons.

Terms (runs of word characters, lower-cased) whose frequency among distinct texts lies in a band make up the
lexicon: rarer terms are chance, commoner ones say nothing. At the band's lower edge of a fraction f of
the distinct texts, no more than (terms of an average one) / f terms can lie in it, however many
there are, so the lexicon is of bounded size and is broadcast. A text's fingerprint has one
hash for each randomised subset of the lexicon: that of the text's distinct terms in it, sorted. The
subsets keep from one term in 8 to one in 256, so that texts of any length have subsets that survive an
edit of a part of it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm import bloom
from pellucid.llm.common import materialize, shuffle_partitions, utf8

LOW, HIGH = 0.01, 0.3
#: Subsets that keep one term in 2 ** s, for each s.
SCALES, EACH = (3, 4, 5, 6, 7, 8), 8
#: More terms than this can't be in the band unless an average text has 20,000 distinct ones.
LEXICON_LIMIT = 2_000_000
HELD_TERMS = 1 << 18
LONG_TERM = 64

_WORD = re.compile(r"\w+")


def terms(text: str) -> set[str]:
    """Distinct terms; a very long one stands under its hash."""
    found = set(_WORD.findall(text.lower()))
    return {t if len(t) <= LONG_TERM else xxhash.xxh3_128_hexdigest(t) for t in found}


def _term_counts(batches):
    counts: Counter[str] = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "k"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(terms(text.as_py() or ""))
        if len(counts) > HELD_TERMS:
            yield rows()
            counts.clear()
    yield rows()


def _single(bits):
    """Texts that the filter of repeated ones does not hold."""

    def run(batches):
        for batch in batches:
            yield batch.select(["text"]).filter(pa.array(~bloom.may_hold(bits.value, batch.column("key").to_numpy())))

    return run


def _repeated(bits):
    """Texts that the filter of repeated ones may hold, packed, each once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, packed = [], []
            for at in np.flatnonzero(bloom.may_hold(bits.value, batch.column("key").to_numpy())).tolist():
                key = batch.column("key")[at].as_py()
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(zlib.compress((batch.column("text")[at].as_py() or "").encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "packed"])

    return run


def _unpack_once(batches):
    """Rows come sorted by key: the first of each."""
    last = None
    for batch in batches:
        out = []
        for key, packed in zip(batch.column("key").to_pylist(), batch.column("packed"), strict=True):
            if key != last:
                out.append(zlib.decompress(packed.as_buffer()).decode())
            last = key
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """The terms of column ``text`` in the band, in order; at least one document and two are its edges.

    Frequencies are over distinct texts, told apart by a 64-bit hash, so that copies of a text cannot
    push its terms out of the band. Only texts that a Bloom filter of repeated hashes holds are exchanged.
    """
    spark = texts.sparkSession
    keyed = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    kinds = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")))
    n = kinds.count()
    bits = spark.sparkContext.broadcast(bloom.build(kinds.where("k > 1").select("key")))
    once = keyed.mapInArrow(_repeated(bits), "key long, packed binary").repartition(shuffle_partitions(spark), "key")
    once = once.sortWithinPartitions("key").mapInArrow(_unpack_once, "text string")
    counts = keyed.mapInArrow(_single(bits), "text string").union(once).mapInArrow(_term_counts, "term string, k long").groupBy("term").agg(F.sum("k").alias("k"))
    found = counts.where(F.col("k").between(low * n, max(high * n, 2))).select("term").limit(LEXICON_LIMIT + 1).collect()
    bits.destroy()
    if len(found) > LEXICON_LIMIT:
        raise ValueError("the band holds too many terms to broadcast: raise its lower edge")
    return sorted(row["term"] for row in found)


class Fingerprinter:
    """Fingerprints of texts by one lexicon."""

    def __init__(self, words: list[str]):
        self.place = {w: k for k, w in enumerate(words)}
        base = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        self.member = np.zeros((len(words), len(SCALES) * EACH), dtype=bool)
        for k in range(self.member.shape[1]):
            draw = (base ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
            draw = (draw ^ (draw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.member[:, k] = draw >> np.uint64(64 - SCALES[k // EACH]) == 0
        self.base = base

    def __call__(self, text: str) -> list[str]:
        """One hash of eight hex digits per subset, empty where the text has no term of it.

        A text without any term of the lexicon has one hash throughout, that of all its terms.
        """
        found = terms(text)
        own = sorted(self.place[t] for t in self.place.keys() & found)
        if not own:
            whole = xxhash.xxh3_64_hexdigest(" ".join(sorted(found)))[:8]
            return [whole] * self.member.shape[1]
        rows, member = self.base[own], self.member[own]
        return [xxhash.xxh3_64_hexdigest(rows[member[:, k]].tobytes())[:8] if any_ else "" for k, any_ in enumerate(member.any(axis=0).tolist())]


def likeness(a: list[str], b: list[str]) -> float:
    """The share of equal hashes among the subsets of which either text has terms; 1 if none has any."""
    told = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in told) / len(told) if told else 1.0


def edit(text: str, other: str) -> str:
    """The text with its last floor(n / 2) code points replaced by as many first ones of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _deal(edges: np.ndarray, heads: dict[int, tuple[int, int | None, int]]):
    """Rows by bucket, texts packed for the exchange; a bucket's first row also goes to the bucket before.

    heads: for each bucket its first row's id and hash, and the bucket that it is lent to.
    """

    def run(batches):
        for batch in batches:
            out = []
            for key, tie, text in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), strict=True):
                bucket = _bucket(edges, key)
                packed = zlib.compress(text.as_buffer().to_pybytes(), 1)
                out.append((bucket, 0, key, tie, packed))
                first, first_tie, to = heads[bucket]
                if (key, tie) == (first, first_tie):
                    out.append((to, 1, key, tie, packed))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "lent", "id", "tie", "packed"])

    return run


def _buckets(edges: np.ndarray):
    def run(batches):
        for batch in batches:
            found = pa.array([_bucket(edges, key) for key in batch.column("id").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([found, *batch.columns], names=["bucket", "id", "tie"])

    return run


def _bucket(edges: np.ndarray, key: int | None) -> int:
    """Buckets number the ranges of ids from the greatest on; null ids have the last."""
    return len(edges) + 1 if key is None else len(edges) - int(np.searchsorted(edges, key, side="right"))


def _compare(words):
    """Rows come by bucket, in order; a bucket's last row is lent by the next and only serves as next text."""

    def run(batches):
        prints, last, out = Fingerprinter(words.value), None, []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

        for batch in batches:
            for bucket, lent, key, packed in zip(*(batch.column(c) for c in ("bucket", "lent", "id", "packed")), strict=True):
                bucket, lent, key = bucket.as_py(), lent.as_py(), key.as_py()
                text = zlib.decompress(packed.as_buffer()).decode()
                own = prints(text)
                if last is not None and last[0] == bucket:
                    before, mark = last[2], last[3]
                    edited = edit(before, text)
                    other = prints(edited)
                    out.append((last[1], len(before), hashlib.sha256(edited.encode()).hexdigest(), ".".join(mark), ".".join(other), likeness(mark, other), likeness(mark, own)))
                last = None if lent else (bucket, key, text, own)
                if len(out) >= 512:
                    yield rows()
                    out = []
        if out:
            yield rows()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    A text's edited text has its last half replaced by the first code points of the next document in
    descending order of the id (the last one's next is the first). One row per row of ``docs``: its id
    (``id_col``), ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. Null texts count as empty; null ids come after all others; rows of one
    id are in the order of a hash of their text. Equal texts have equal fingerprints. Other columns are
    ignored; an empty table gives an empty result; a single document is its own next.

    Texts are dealt once, packed, by ranges of the id; of each range only its first row goes to a second task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = spark.sparkContext.broadcast(lexicon(rows.select("text"), low, high))

    n = shuffle_partitions(spark)
    bounds = rows.select("id").where("id IS NOT NULL").approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    edges = np.array(sorted({int(b) for b in bounds}), dtype=np.int64)

    rows = rows.withColumn("tie", F.xxhash64("text"))
    # ids descend, so a bucket's first row has the greatest id, and the least hash among equal ids
    found = rows.select("id", "tie").mapInArrow(_buckets(edges), "bucket long, id long, tie long")
    firsts = found.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("tie").alias("tie"))).alias("first"))
    listed = sorted((r["bucket"], r["first"]["id"], ~r["first"]["tie"]) for r in firsts.collect())
    heads = {b: (key, tie, listed[k - 1][0]) for k, (b, key, tie) in enumerate(listed)}
    placed = rows.select("id", "tie", F.col("text").cast("binary").alias("text")).mapInArrow(_deal(edges, heads), "bucket long, lent int, id long, tie long, packed binary")
    placed = placed.repartition(n, "bucket")
    placed = placed.sortWithinPartitions("bucket", "lent", F.col("id").desc_nulls_last(), "tie")
    return placed.select("bucket", "lent", "id", "packed").mapInArrow(_compare(words), _OUT).withColumnRenamed("id", id_col)
