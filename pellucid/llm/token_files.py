"""Token ids in Arrow stream files of equal-length sequences.

A file holds the ids of neighbouring documents, end to end, as record batches of ``BATCH`` sequences of
``length`` ids each: a fixed-size list of unsigned integers and one of mask bits (set: an id, clear:
padding behind the last document). All batches but the last have the same number of bytes, so the place of any
sequence follows from its number, and :class:`TokenFile` maps a file and views sequences without
copying. A second stream beside it lists the documents: id, first place in the file, number of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.bpe import PieceEncoder
from pellucid.llm.common import materialize, shared_dir, shuffle_partitions, utf8
from pellucid.llm.files import create, open_input

LENGTH, BATCH = 2048, 128
#: Texts that are encoded together.
TEXTS_AT_ONCE = 256
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, width: str) -> pa.Schema:
    ids = pa.uint16() if width == "<u2" else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class TokenWriter:
    """Writes one file and its list of documents."""

    def __init__(self, folder: str, name: str, length: int = LENGTH, width: str = "<u2"):
        self.length, self.width, self.schema = length, width, _schema(length, width)
        self.sink, self.index_sink = create(folder, f"{name}.arrows"), create(folder, f"{name}.docs.arrows")
        self.out, self.index = pa.ipc.new_stream(self.sink, self.schema), pa.ipc.new_stream(self.index_sink, _INDEX)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * BATCH:
            self._flush(False)
        if len(self.docs) >= 1 << 14:
            self._list()

    def _list(self) -> None:
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=_INDEX))
            self.docs = []

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.width)
        step = self.length * BATCH
        full = len(ids) if last else len(ids) // step * step
        for at in range(0, full, step):
            part = ids[at : min(at + step, full)]
            rows = -(-len(part) // self.length)
            mask = np.ones(rows * self.length, dtype=bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(len(mask) - len(part), self.width)]).astype(self.width)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (part, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.size = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        self._list()
        for x in (self.out, self.index, self.sink, self.index_sink):
            x.close()


class TokenFile:
    """A mapped file whose sequences are views into it."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.map))
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the k-th sequence, without a copy (the mask's bits stay packed)."""
        batch, row = self.batches[k // self.rows], k % self.rows
        ids, mask = (batch.column(c) for c in (0, 1))
        length = ids.type.list_size
        place = (ids.offset + row) * length
        return ids.values.slice(place, length).to_numpy(zero_copy_only=True), mask.values.slice(place, length)


def _encode(path: str, end_id: int, bounds: list[int], width: str):
    edges = np.array(bounds, dtype=np.int64)

    most = np.iinfo(width).max

    def narrowed(ids: np.ndarray) -> bytes:
        if ids.max() > most:
            raise ValueError(f"id {ids.max()} does not fit the files' {width}")
        return ids.astype(width).tobytes()

    def run(batches):
        encoder = PieceEncoder.of(path, drops_space=True)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = [narrowed(np.frombuffer(i + end, dtype="<u4")) for i in encoder.encode_all([t or "" for t in part.column("text").to_pylist()])]
                keys = [-1 if k is None else int(np.searchsorted(edges, k, side="right")) for k in part.column("id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), part.column("id"), part.column("tie"), pa.array(ids, pa.binary())], names=["bucket", "id", "tie", "ids"])

    return run


def _write(folder: str, length: int, width: str):
    def run(batches):
        writer, bucket, done = None, None, []

        def finish():
            writer.close()
            done.append((bucket, name, writer.total))

        for batch in batches:
            for key, doc, ids in zip(batch.column("bucket").to_pylist(), batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                if writer is None or key != bucket:
                    if writer is not None:
                        finish()
                    # an attempt that is lost or repeated leaves another name, which no list has
                    bucket, name = key, f"ids-{key:06d}-{TaskContext.get().taskAttemptId()}"
                    writer = TokenWriter(folder, name, length, width)
                writer.add(doc, np.frombuffer(ids.as_buffer(), dtype=width))
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["bucket", "name", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, width: str = "<u2") -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the id.

    Returns the list of the files: ``bucket`` (their order), ``name``, ``n_tokens``. Null ids come first,
    equal ids are ordered by a hash of their text, a null text is empty and has the end id alone. Each
    file takes a range of ids; the ranges are quantiles, so files are about equal in documents.
    """
    spark = docs.sparkSession
    n = max(2, shuffle_partitions(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("tie"))
    bounds = rows.select("id").where("id IS NOT NULL").approxQuantile("id", [k / n for k in range(1, n - 1)], 0.25 / n)
    edges = sorted({int(b) for b in bounds})
    encoded = rows.mapInArrow(_encode(tokenizer_path, end_id, edges, width), "bucket int, id long, tie long, ids binary")
    dealt = encoded.repartitionById(n, F.col("bucket") + 1).sortWithinPartitions("bucket", "id", "tie").select("bucket", "id", "ids")
    return materialize(dealt.mapInArrow(_write(folder, length, width), "bucket int, name string, n_tokens long"))


def _documents(name: str) -> Iterator[tuple[int | None, int, int]]:
    with open_input(f"{name}.docs.arrows") as source:
        for batch in pa.ipc.open_stream(source):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _ids(name: str) -> Iterator[np.ndarray]:
    """The ids of a file, a batch at a time, without the padding."""
    with open_input(f"{name}.arrows") as source:
        for batch in pa.ipc.open_stream(source):
            yield batch.column(0).flatten().to_numpy()[: batch.column(1).flatten().true_count]


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                parts, rest, out = _ids(f"{folder}/{name}"), np.zeros(0, np.uint32), []
                for doc, start, n in _documents(f"{folder}/{name}"):
                    check, missing = 0, n
                    while missing:
                        if not len(rest):
                            rest = next(parts)
                        check = zlib.crc32(rest[:missing].astype("<u4").tobytes(), check)
                        missing, rest = missing - len(rest[:missing]), rest[missing:]
                    out.append((doc, first + start, n, check))
                for at in range(0, len(out), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + (1 << 14)], strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it, in all files. ``files`` has one row per file, and
    only these rows, whose number the writer's partitions bound, pass through the driver.
    """
    spark = files.sparkSession
    listed, first = [], 0
    for row in sorted(files.collect(), key=lambda r: r["bucket"]):
        listed.append((row["name"], first))
        first += row["n_tokens"]
    names = spark.createDataFrame(listed, "name string, first long").repartition(max(1, len(listed)), "name")
    return names.mapInArrow(_read(folder), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to files in the shared folder and read them back; see above.

    Repeated rows and null ids are written like others; other columns are ignored; an empty table makes
    no file and gives an empty result.
    """
    folder = f"{shared_dir(docs.sparkSession)}-tokens"
    return read_token_files(write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col), folder, id_col)
