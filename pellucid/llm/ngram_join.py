"""N-gram Jaccard join by rare-first prefix filtering.

``ngram_join`` finds, exactly, which texts' sets of word shingles have a Jaccard similarity of at
least ``percent`` hundredths:

1. Every text becomes a set of 64-bit shingle hashes; equal sets form one class at once.
2. A two-row count sketch of fixed size takes the document frequency of every shingle, copies that a
   task meets counted once. Shingles are
   ordered by sketched frequency, rarest first, then by hash: one total order for all texts, which is
   all that prefix filtering needs to be exact.
3. A set's first ``n - ceil(t n) + 1`` shingles in this order are its prefix. Prefix shingles are dealt
   by hash into packed blobs, so that one exchange carries some 15 bytes for each. A shingle that the sketch
   knows to be very frequent is salted, so that no task holds all of its texts; as no task then sees all
   of its pairs either, its whole list is kept.
4. Members of one shingle's list are paired under the length and positional filters: first each with
   a hub, then with a few more where lists fall apart, and then, the components of the links found so far being
   known, only across components. Groups of copies thus cost as much as they have members.
5. Pairs pass a suffix filter (the sets' counts in hash ranges bound their overlap from above) and
   are verified once each on the whole sets, hub by hub; see ``set_pairs``.
6. Where the links of each set are asked for, the sets of a component are written as differences to one
   of them and held against each other block by block: no pair is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm import bloom
from pellucid.llm.common import materialize, shuffle_partitions, utf8
from pellucid.llm.components import connected_components
from pellucid.llm.set_pairs import TEXTS_AT_ONCE, link_counts, linked, pack, range_counts
from pellucid.llm.shingles import mix64, shingle_sets

#: The sketch has two rows of 2 ** this many counters, one for so many bytes of the texts until they are the most.
LEAST_SKETCH, MOST_SKETCH, BYTES_PER_COUNTER = 16, 21, 2048
CHUNK_BITS = 14
#: Bytes of text whose prefixes make one bucket, at most.
BUCKET_TEXT = 1 << 27
#: Shingles above this many texts over the sketch's background are salted.
LIST_LIMIT = 1 << 20
#: Members of a list's main component that its others are held against in the second round.
HUBS = 3
#: Hashes that a task holds before it counts them, and prefix rows before it deals them out.
HELD_HASHES = HELD_ROWS = 1 << 17

_PREFIX = np.dtype([("token", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("pos", "<u4")])
#: Within a bucket so many bytes of a prefix hash tell its lists apart; the few that they don't only give more candidates.
TOKEN_BYTES = 5


def _slots(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (tokens & mask).astype(np.int64), ((tokens >> np.uint64(bits)) & mask).astype(np.int64)


def _loads(rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What the sketch says of the hashes: never less than their counts."""
    first, second = _slots(tokens, rows.shape[1].bit_length() - 1)
    return np.minimum(rows[0][first], rows[1][second])


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of a batch's rows with the shingle sets of their bodies."""
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        part = batch.slice(at, TEXTS_AT_ONCE)
        yield part, list(shingle_sets(part.column("body").to_pylist(), width))


def _signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _pack_counts(chunk: np.ndarray) -> bytes:
    return zlib.compress(chunk.astype(np.min_scalar_type(int(chunk.max()))).tobytes(), 1)


def _unpack_counts(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, dtype=f"<u{len(raw) >> CHUNK_BITS}").astype(np.int64)


def _profiles(width: int, bits: int):
    """Rows of a text (part null: id, key, n, sig) and, at a task's end, chunks of its sketch."""
    names = ["id", "key", "n", "sig", "part", "counts"]

    def run(batches):
        rows = np.zeros((2, 1 << bits), dtype=np.int64)
        seen: set[int | None] = {None}
        held: list[np.ndarray] = []

        def count():
            for row, slot in zip(rows, _slots(np.concatenate(held), bits), strict=True):
                np.add.at(row, slot, 1)
            held.clear()

        for batch in batches:
            for part, sets in _sets(batch, width):
                sizes, signatures = [len(s) for s in sets], [_signature(s) if len(s) else None for s in sets]
                fresh = {g: s for g, s in zip(signatures, sets, strict=True) if g not in seen}
                seen.update(fresh)
                held += fresh.values()
                if sum(map(len, held)) > HELD_HASHES:
                    count()
                none = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(sizes, pa.int64()), pa.array(signatures, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        if held:
            count()
        chunks = rows.reshape(-1, 1 << CHUNK_BITS)
        if full := [k for k in range(len(chunks)) if chunks[k].any()]:
            none = [pa.nulls(len(full), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(full, pa.int32()), pa.array([_pack_counts(chunks[k]) for k in full], pa.binary())], names=names)

    return run


def _add_chunks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            row = _unpack_counts(counts)
            total[part] = total[part] + row if part in total else row
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(map(_pack_counts, total.values()), pa.binary())], names=["part", "counts"])


def _sketch(profiles: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: two rows of 2 ** bits counters, of which MOST_SKETCH bounds the number."""
    chunks = profiles.where("part IS NOT NULL").select("part", "counts")
    one = chunks.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16))).repartition("part", "salt").select("part", "counts")
    two = one.mapInArrow(_add_chunks, "part int, counts binary").repartition("part").mapInArrow(_add_chunks, "part int, counts binary")
    sketch = np.zeros((2 << bits >> CHUNK_BITS, 1 << CHUNK_BITS), dtype=np.int64)
    for row in two.collect():
        sketch[row["part"]] = _unpack_counts(row["counts"])
    return sketch.reshape(2, -1).astype(np.int32 if sketch.max() < 1 << 31 else np.int64)


def _pack_prefixes(rows: np.ndarray, token_bytes: int) -> bytes:
    """Rows column by column, led by their number; sizes and places, byte by byte, compress well."""

    def planes(name: str) -> np.ndarray:
        return np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), -1).T

    small = planes("n").tobytes() + planes("pos").tobytes()
    return len(rows).to_bytes(4, "little") + planes("token")[:token_bytes].tobytes() + rows["sig"].tobytes() + pa.compress(small, codec="zstd", asbytes=True)


def _unpack_prefixes(packed: bytes, token_bytes: int) -> np.ndarray:
    count = int.from_bytes(packed[:4], "little")
    rows = np.zeros(count, dtype=_PREFIX)
    token = np.zeros((count, 8), dtype=np.uint8)
    token[:, :token_bytes] = np.frombuffer(packed, np.uint8, token_bytes * count, 4).reshape(token_bytes, count).T
    rows["token"] = token.view("<u8").ravel()
    at = 4 + token_bytes * count
    rows["sig"] = np.frombuffer(packed, "<i8", count, at)
    small = pa.decompress(packed[at + 8 * count :], decompressed_size=8 * count, codec="zstd", asbytes=True)
    for k, name in enumerate(("n", "pos")):
        rows[name] = np.ascontiguousarray(np.frombuffer(small, np.uint8, 4 * count, 4 * count * k).reshape(4, count).T).view("<u4").ravel()
    return rows


def _prefixes(sketch, percent: int, width: int, buckets: int):
    """Packed prefix shingles of each distinct set that the task has met, dealt into buckets."""

    def run(batches):
        rows = sketch.value
        background = rows.mean() + 6 * rows.std() if rows.any() else 0
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def deal():
            packed = np.concatenate(held)
            load = _loads(rows, packed["token"]) - background
            salts = np.maximum(1, np.ceil(load / LIST_LIMIT)).astype(np.uint64)
            bucket = (mix64(packed["token"] + packed["sig"].astype(np.uint64) % salts) % np.uint64(buckets)).astype(np.int64)
            salted = salts > 1
            order = np.lexsort((salted, bucket))
            packed, bucket, salted = packed[order], bucket[order], salted[order]
            cut = np.flatnonzero((np.diff(bucket) != 0) | (salted[1:] != salted[:-1])) + 1
            first = np.concatenate(([0], cut))
            blobs = [_pack_prefixes(x, 8 if far else TOKEN_BYTES) for x, far in zip(np.split(packed, cut), salted[first].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(salted[first]), pa.array(blobs, pa.binary())], names=["bucket", "salted", "packed"])

        for batch in batches:
            for _, sets in _sets(batch, width):
                for tokens in sets:
                    signature = _signature(tokens)
                    if not len(tokens) or signature in seen:
                        continue
                    seen.add(signature)
                    n = len(tokens)
                    order = np.lexsort((tokens, _loads(rows, tokens)))[: n - -(-percent * n // 100) + 1]
                    out = np.empty(len(order), dtype=_PREFIX)
                    out["token"], out["sig"], out["n"], out["pos"] = tokens[order], signature, n, np.arange(len(order))
                    held.append(out)
                    size += len(out)
                if size > HELD_ROWS:
                    yield deal()
                    held, size = [], 0
        if held:
            yield deal()

    return run


def _may_pair(n, pos, m, other, percent):
    """Length and positional filter: sizes n, m and places of a common shingle in the sets' order."""
    if hasattr(n, "__array__"):
        low, high, rest = np.minimum(n, m), np.maximum(n, m), np.minimum(n - pos, m - other)
    else:
        low, high, rest = F.least(n, m), F.greatest(n, m), F.least(n - pos, m - other)
    return (low * 100 >= high * percent) & (rest * (100 + percent) >= (n + m) * percent)


def _lists(percent: int):
    """Of a bucket's prefix shingles, those lists in which some pair can pass the filters.

    Salted lists are kept whole: their pairs may have a member in another bucket.
    """

    def distinct(parts):
        rows = np.concatenate([np.zeros(0, dtype=_PREFIX), *parts])
        parts.clear()
        rows = rows[np.lexsort((rows["sig"], rows["token"]))]
        return rows[np.concatenate((np.ones(min(len(rows), 1), dtype=bool), (rows["token"][1:] != rows["token"][:-1]) | (rows["sig"][1:] != rows["sig"][:-1])))]

    def run(batches):
        parts: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        for batch in batches:
            for bucket, salted, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "salted", "packed")), strict=True):
                rows = _unpack_prefixes(packed, 8 if salted else TOKEN_BYTES)
                if not salted:
                    rows["token"] = mix64(rows["token"] | np.uint64(bucket << 8 * TOKEN_BYTES))
                parts[salted].append(rows)
        whole = distinct(parts[True])
        rows = distinct(parts[False])
        yield from batches_of(whole)
        if not len(rows):
            return
        edge = np.flatnonzero(np.concatenate(([True], rows["token"][1:] != rows["token"][:-1], [True])))
        length = np.diff(edge)
        keep = np.zeros(len(rows), dtype=bool)
        n, pos = rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
        two = edge[:-1][length == 2]
        fits = two[_may_pair(n[two], pos[two], n[two + 1], pos[two + 1], percent)]
        keep[fits] = keep[fits + 1] = True
        for a, k in zip(edge[:-1][length > 2].tolist(), length[length > 2].tolist(), strict=True):
            if k > 256:
                keep[a : a + k] = True
                continue
            own, at = n[a : a + k, None], pos[a : a + k, None]
            ok = _may_pair(own, at, own.T, at.T, percent)
            np.fill_diagonal(ok, False)
            keep[a : a + k] = ok.any(axis=0)
        yield from batches_of(rows[keep])

    def batches_of(rows):
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[c].astype(np.int64)) for c in ("token", "sig", "n", "pos")],
                names=["token", "sig", "n", "pos"],
            )

    return run


def _packed_rows(width: int, sieve):
    names = ["at", "key", "ranges", "packed"]

    def run(batches):
        for batch in sieve(batches):
            for part, sets in _sets(batch, width):
                packed = [pack(t) for t in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("key"), pa.array([range_counts(s) for s in sets], pa.binary()), pa.array(packed, pa.binary())], names=names)

    return run


def _whole_texts(classes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``(sig, ranges, packed)`` of the classes, from the one row of each that they name.

    Only those rows' texts are exchanged: a Bloom filter keeps most others out and the join on the row's
    id and text hash all of them.
    """
    sieve = bloom.sieve(classes.select("key"), "key")
    some = rows.select("at", "key", "body").mapInArrow(_packed_rows(width, sieve), "at long, key long, ranges binary, packed binary")
    return materialize(some.join(classes, ["at", "key"]).dropDuplicates(["at", "key"]).select("sig", "ranges", "packed"))


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once; where it came both ways, under the lesser of its hubs."""
    both = pairs.groupBy(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b")).agg(F.min("hub").alias("hub"))
    return both.select("a", "b", "hub", (F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("sig"))


def _first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member with the hub that most of its lists share, one pair for each.

    A list's hub is the member that has its shingle earliest. Variants of a text have rare shingles of
    their own, which come first in their order and push the common ones back; so the hub tends to be the
    text that the others vary.
    """
    hubs = lists.groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("rank"), "sig", "n", "pos")).alias("hub"))
    near = lists.join(hubs, "token").where(F.col("sig") != F.col("hub.sig"))
    near = near.where(_may_pair(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    shared = near.groupBy("sig", F.col("hub.sig").alias("hub")).agg(F.count(F.lit(1)).alias("k"))
    best = shared.groupBy("sig").agg(F.max(F.struct("k", "hub")).alias("best"))
    return best.select(F.col("best.hub").alias("hub"), "sig")


def _hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The members outside a list's main component, with some of those inside, drawn by hashes."""
    inside = lists.where("component = main")
    ranks = [F.col("pos") / F.col("n"), *(F.xxhash64("sig", F.lit(k)) for k in range(1, HUBS))]
    seats = [F.min(F.struct(r.cast("double").alias("rank"), "sig", "n", "pos")) for r in ranks]
    seats = [F.struct(x["sig"].alias("sig"), x["n"].alias("n"), x["pos"].alias("pos")) for x in seats]
    hubs = inside.groupBy("token").agg(F.array_distinct(F.array(*seats)).alias("hubs")).select("token", F.explode("hubs").alias("hub"))
    near = lists.where("component <> main").join(hubs, "token")
    near = near.where(_may_pair(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    return near.select(F.col("hub.sig").alias("hub"), "sig")


def _open_lists(lists: DataFrame, component: DataFrame) -> DataFrame:
    """The lists that the links so far leave in several components; ``main`` is the most frequent one."""
    named = lists.select("token", "sig", "n", "pos").join(component.withColumnRenamed("node", "sig"), "sig", "left")
    named = named.withColumn("component", F.coalesce("component", "sig"))
    each = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = each.groupBy("token").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("k", "component")).alias("main"))
    return materialize(named.join(main.where("kinds > 1").select("token", "main"), "token"))


def _cross_pairs(open_lists: DataFrame, percent: int) -> DataFrame:
    """Members of one list in different components.

    Those outside a list's main component are held against the rest of the list, so that the members of
    a large component are not compared with each other.
    """
    x, y = open_lists.where("component <> main").alias("x"), open_lists.alias("y")
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.sig") < F.col("y.sig")))
        & _may_pair(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent),
    )
    return pairs.select(F.col("x.sig").alias("hub"), F.col("y.sig").alias("sig"))


def _extended(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, component)`` after more links: only the components that they touch are put together anew."""
    if component is None:
        return materialize(connected_components(links, "hub", "sig"))
    if links.isEmpty():
        return component
    ends = links.select(F.col("hub").alias("node")).unionAll(links.select(F.col("sig").alias("node"))).distinct()
    nodes = ends.join(component, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    nodes = materialize(nodes)
    x, y = nodes.toDF("hub", "x"), nodes.toDF("sig", "y")
    merged = connected_components(links.join(x, "hub").join(y, "sig").where("x <> y"), "x", "y").toDF("component", "whole")
    return materialize(nodes.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, count_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id (``id_col``), ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id reachable over links, its own included. With ``count_links`` a last
    column ``n_links`` has the number of other distinct sets that the row's set links with, those inside a
    component that other links already hold together among them. Null, empty and blank texts have no shingles
    and link with nothing. Rows with a null id take part and may connect others, but name no component.
    Repeated rows and ids give one row each. Other columns are ignored; an empty table gives an empty
    result. Sets are told apart by 64-bit hashes of their shingles' 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("body")).withColumn("key", F.xxhash64("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, (size // BYTES_PER_COUNTER).bit_length()))
    profiles = materialize(rows.select("id", "key", "body").mapInArrow(_profiles(width, bits), "id long, key long, n long, sig long, part int, counts binary"))
    known = profiles.where("part IS NULL").select("id", "key", "n", "sig")
    sketch = spark.sparkContext.broadcast(_sketch(profiles, bits))

    buckets = max(2 * shuffle_partitions(spark), -(-size // BUCKET_TEXT))
    dealt = rows.select("body").mapInArrow(_prefixes(sketch, percent, width, buckets), "bucket int, salted boolean, packed binary")
    lists = materialize(dealt.repartitionById(buckets, "bucket").mapInArrow(_lists(percent), "token long, sig long, n long, pos long"))
    sketch.destroy()

    # each set that a list names, and the first of the rows that have it
    listed = known.join(lists.select("sig").distinct(), "sig", "left_semi")
    first = listed.groupBy("sig").agg(F.min(F.struct("id", "key")).alias("row"))
    classes = materialize(first.select("sig", F.coalesce("row.id", "row.key").alias("at"), F.col("row.key").alias("key")))
    texts = _whole_texts(classes, rows.withColumn("at", F.coalesce("id", "key")), width)

    tried = materialize(_once(_first_pairs(lists, percent)))
    links = linked(tried.select("hub", "sig"), texts, width, percent)
    component = _extended(None, links)
    for candidates in (_hub_pairs, _cross_pairs):
        lists = _open_lists(lists, component)
        pairs = materialize(_once(candidates(lists, percent)).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        found = linked(pairs.select("hub", "sig"), texts, width, percent)
        component = _extended(component, found)
        links, tried = links.unionAll(found), tried.unionAll(pairs)

    named = known.join(component.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    extra = ["n_links"] if count_links else []
    if count_links:
        named = named.join(link_counts(texts, component, links, width, percent), "sig", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    named = materialize(named.select("id", "n", "component", *extra))
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
    return named.join(least, "component", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), *extra
    )
