"""BPE encoding and decoding with reuse of content-defined chunks.

``chunked_bpe`` encodes every whole text exactly as a byte-level file of the ``tokenizers`` library does:

1. A rolling hash over the last ``WINDOW`` bytes cuts texts into chunks of about two kilobytes wherever
   its low bits are zero, so equal passages give equal chunks whatever stands before them.
2. Chunk hashes are counted over all texts (no text is shuffled), and those that occur twice or more go
   into a Bloom filter of fixed size, the only thing that is broadcast.
3. Chunks that the filter doesn't have are encoded where they are read. The others are dealt by hash,
   encoded once each, and joined back to the texts that have them. A false positive only means that a
   single chunk takes that way.
4. The joins of neighbouring chunks are repaired: the ids between the last safe point on the left and
   the first on the right are replaced by re-encoding their bytes, and the window grows until the ids
   re-encoded on both its sides agree with those that were there.

Decoding maps the final ids back to bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm import bloom
from pellucid.llm.bpe import ID, PieceEncoder, byte_table
from pellucid.llm.common import materialize, utf8
from pellucid.llm.shingles import BLOCK_BYTES, byte_values, mix64, powers

WINDOW, CHUNK_BITS = 48, 11
#: Counts held in a task before they are handed on.
HELD_COUNTS = 1 << 18

_BLANK = b" \t\n\r\x0b\x0c"
_tables: dict[str, tuple[list[bytes], list[str]]] = {}


def _cuts(text: bytes) -> list[int]:
    """The ends of the text's chunks; a cut never falls inside a character."""
    found = []
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, max(0, len(data) - WINDOW), BLOCK_BYTES - WINDOW):
        block = data[at : at + BLOCK_BYTES]
        n = len(block)
        if n <= WINDOW:
            break
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_values()[block] * powers(n), out=sums[1:])
        rolled = mix64((sums[WINDOW:] - sums[:-WINDOW]) * powers(n - WINDOW + 1, inverse=True))
        end = np.flatnonzero(rolled >> np.uint64(64 - CHUNK_BITS) == 0) + WINDOW
        end = end[end < n]
        found += (at + end[(block[end] & 0xC0) != 0x80]).tolist()
    return sorted({*found, len(text)} - {0})


def _chunks(text: bytes) -> list[bytes]:
    out, at = [], 0
    for end in _cuts(text):
        out.append(text[at:end])
        at = end
    return out


def _hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _chunk_counts(batches):
    counts: Counter[int] = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(counts.values(), pa.int64())], names=["hash", "k"])

    for batch in batches:
        for body in batch.column("body"):
            counts.update(map(_hash, _chunks(body.as_buffer().to_pybytes())))
        if len(counts) > HELD_COUNTS:
            yield rows()
            counts.clear()
    yield rows()


def _repeated_filter(rows: DataFrame) -> np.ndarray:
    """The Bloom filter of the hashes of chunks that occur more than once."""
    counts = rows.select("body").mapInArrow(_chunk_counts, "hash long, k long")
    repeated = counts.groupBy("hash").agg(F.sum("k").alias("k")).where("k > 1").select("hash")
    return bloom.build(materialize(repeated))


class _Codec:
    """Encodes chunks, repairs their joins and digests the result, for one vocabulary."""

    def __init__(self, path: str):
        self.encoder = PieceEncoder.of(path, drops_space=False)
        if path not in _tables:
            table = byte_table(self.encoder.tokenizer)
            _tables[path] = table, [str(i) for i in range(len(table))]
        self.bytes_of, self.decimal = _tables[path]

    def encode(self, chunk: bytes) -> array:
        return self.encode_all([chunk])[0]

    def encode_all(self, chunks: list[bytes]) -> list[array]:
        return [array(ID, i) for i in self.encoder.encode_all([c.decode("utf-8", "replace") for c in chunks])]

    def text(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _safe(self, before: int, after: int) -> bool:
        """Between these ids a visible ASCII character is followed by white space."""
        left, right = self.bytes_of[before], self.bytes_of[after]
        return bool(left and right) and 0x20 < left[-1] < 0x7F and right[0] in _BLANK

    def _back(self, ids: array, at: int) -> int:
        at -= 1
        while at > 0 and not self._safe(ids[at - 1], ids[at]):
            at -= 1
        return max(at, 0)

    def _on(self, ids: array, at: int) -> int:
        at += 1
        while at < len(ids) and not self._safe(ids[at - 1], ids[at]):
            at += 1
        return min(at, len(ids))

    def join(self, parts: list[array]) -> array:
        """The ids of the whole text from those of its chunks."""
        done = array(ID)
        for part in parts:
            if not done or not part:
                done.extend(part)
                continue
            low, high = self._back(done, len(done)), self._on(part, 0)
            while True:
                # one safe stretch more on either side has to come out as it was
                lower, higher = self._back(done, low), self._on(part, high)
                fresh = self.encode(self.text(done[lower:]) + self.text(part[:higher]))
                keep_low, keep_high = low - lower, higher - high
                agrees = fresh[:keep_low] == done[lower:low] and fresh[len(fresh) - keep_high :] == part[high:higher]
                if agrees or (lower == low == 0 and higher == high == len(part)):
                    break
                low, high = lower, higher
            del done[lower:]
            done.extend(fresh)
            done.extend(part[higher:])
        return done

    def digests(self, ids: array) -> tuple[int, str, str]:
        decoded = self.text(ids).decode("utf-8", "replace").encode()
        listed = ",".join(map(self.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


_ENCODED = "row long, id long, n_tokens long, ids_sha256 string, decoded_sha256 string, place int, hash long, ids binary, chunk binary"
_ENCODED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_ENCODED_NAMES = [f.split()[0] for f in _ENCODED.split(", ")]


def _encode(path: str, bits):
    """Finished texts; of the others, their chunks in place; and each chunk that is encoded elsewhere."""

    def run(batches):
        codec, have = _Codec(path), bits.value
        row, sent = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out = []
                part = batch.slice(start, 512)
                for key, body in zip(part.column("id").to_pylist(), part.column("body"), strict=True):
                    row += 1
                    chunks = _chunks(body.as_buffer().to_pybytes())
                    hashes = [_hash(c) for c in chunks]
                    shared = bloom.may_hold(have, np.array(hashes, dtype=np.int64)).tolist()
                    if not any(shared):
                        ids = codec.join(codec.encode_all(chunks))
                        out.append((row, key, *codec.digests(ids), None, None, None, None))
                        continue
                    for place, (chunk, h, away) in enumerate(zip(chunks, hashes, shared, strict=True)):
                        ids = None if away else codec.encode(chunk).tobytes()
                        out.append((row, key, None, None, None, place, h if away else None, ids, None))
                        if away and h not in sent:
                            sent.add(h)
                            out.append((None, None, None, None, None, None, h, None, chunk))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ENCODED_TYPES, strict=True)], names=_ENCODED_NAMES)

    return run


def _encode_chunks(path: str):
    def run(batches):
        codec = _Codec(path)
        for batch in batches:
            ids = [codec.encode(c.as_buffer().to_pybytes()).tobytes() for c in batch.column("chunk")]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(ids, pa.binary())], names=["hash", "shared"])

    return run


def _finish(path: str):
    def run(batches):
        codec = _Codec(path)
        for batch in batches:
            made = []
            for parts in batch.column("parts"):
                made.append(codec.digests(codec.join([array(ID, p["ids"].as_py()) for p in parts])))
            columns = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, _ENCODED_TYPES[2:5], strict=True))], names=_ENCODED_NAMES[1:5])

    return run


def chunked_bpe(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id (``id_col``), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    tokenizer_path: a byte-level file of the ``tokenizers`` library, at the same place on every executor.

    A null text counts as empty and has no ids. Null ids and repeated rows are kept as they are. Other
    columns are ignored; an empty table gives an empty result. Chunks are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("body"))
    bits = docs.sparkSession.sparkContext.broadcast(_repeated_filter(rows))
    encoded = materialize(rows.mapInArrow(_encode(tokenizer_path, bits), _ENCODED))

    chunks = encoded.where("chunk IS NOT NULL").select("hash", "chunk").dropDuplicates(["hash"])
    chunks = chunks.mapInArrow(_encode_chunks(tokenizer_path), "hash long, shared binary")
    places = encoded.where("place IS NOT NULL").select("row", "id", "place", "hash", "ids")
    filled = places.where("hash IS NOT NULL").join(chunks, "hash").select("row", "id", "place", F.col("shared").alias("ids"))
    filled = filled.union(places.where("hash IS NULL").select("row", "id", "place", "ids"))
    whole = filled.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"))
    joined = materialize(whole.select("id", "parts").mapInArrow(_finish(tokenizer_path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
    alone = encoded.where("n_tokens IS NOT NULL").select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    return alone.union(joined).withColumnRenamed("id", id_col)
