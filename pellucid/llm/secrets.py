"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported by themselves.
Weak candidates - bare random-looking strings, endpoint hosts or URLs, account names - mean nothing
alone: they are reported only where complementary parts of a credential co-occur within one scope. Parts
of a text become rows, and identifiers, secrets and endpoints are joined where they lie within ``SCOPE``
code points of each other, by an equality on text and stretch and a test of the distance. The stretch is
as long as the scope, so a candidate meets the parts that lie in its own stretches, wholly or not, and in
the two neighbouring ones only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import materialize

SCOPE = 200
STRONG = ("assign", "access", "hex")
WEAK = ("bare", "endpoint", "account")
KINDS = (*STRONG, *WEAK)
#: A weak kind is reported beside a part of one of these kinds.
COMPLEMENTS = {
    "bare": ("access", "endpoint", "account"),
    "endpoint": ("access", "assign", "hex", "bare"),
    "account": ("assign", "hex", "bare"),
}
MIN_ASSIGNED, MIN_ENTROPY = 8, 3.5

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+|(?<![\w@.-])(?:[a-z0-9-]{1,63}\.){2,6}(?:com|net|org|io|internal)(?::\d{2,5})?\b", re.ASCII)
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9_])(?i:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.ASCII)


def entropy(text: str) -> float:
    """Shannon entropy of the characters, in bits."""
    return -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values())


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns that stand by themselves, by start and then kind.

    Matches are leftmost and don't overlap within a kind; those too short are dropped. As the access and
    hexadecimal runs are maximal, their least lengths are part of the pattern.
    """
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    found += [(m.start(), m.end(), kind) for kind, p in (("access", _ACCESS), ("hex", _HEX)) for m in p.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates; random-looking strings mix letters and digits."""
    found = []
    for m in _BARE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value) and entropy(value) >= MIN_ENTROPY:
            found.append((m.start(), m.end(), "bare"))
    found += [(m.start(), m.end(), kind) for kind, p in (("endpoint", _ENDPOINT), ("account", _ACCOUNT)) for m in p.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_PART = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_SCANNED = "row long, id long, strong array<struct<start:long,end:long,kind:string>>, weak array<struct<start:long,end:long,kind:string>>"


def _scan(batches):
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column("id").to_pylist()
        rows, strong, weak = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            row += 1
            rows.append(row)
            for out, spans in ((strong, strong_spans(text)), (weak, weak_spans(text))):
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(strong, pa.list_(_PART)), pa.array(weak, pa.list_(_PART))], names=["row", "id", "strong", "weak"])


def _digest(batches):
    for batch in batches:
        out = []
        for strong, linked in zip(batch.column("strong").to_pylist(), batch.column("linked").to_pylist(), strict=True):
            base = [(s["start"], s["end"], s["kind"]) for s in strong]
            every = sorted(base + [(s["start"], s["end"], s["kind"]) for s in linked or ()], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            counts = [sum(s[2] == kind for s in base) for kind in STRONG]
            out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_scan, _SCANNED))


def _linked(scanned: DataFrame) -> DataFrame:
    """``(row, linked)``: the weak candidates beside a complementary part."""
    weak = scanned.where("size(weak) > 0").select("row", F.explode("weak").alias("w"))
    weak = weak.withColumn("stretch", F.explode(F.expr(f"sequence(w.start div {SCOPE} - 1, w.end div {SCOPE} + 1)")))
    parts = scanned.where("size(weak) > 0").select("row", F.explode(F.concat("strong", "weak")).alias("p"))
    parts = parts.withColumn("stretch", F.explode(F.expr(f"sequence(p.start div {SCOPE}, p.end div {SCOPE})")))
    pairs = F.create_map(*[x for kind, others in COMPLEMENTS.items() for x in (F.lit(kind), F.array(*map(F.lit, others)))])
    apart = F.greatest(F.col("p.start") - F.col("w.end"), F.col("w.start") - F.col("p.end"))
    # a candidate that covers the part, or lies in it, is no second part
    near = weak.join(parts, ["row", "stretch"]).where((apart >= 0) & (apart <= SCOPE) & F.array_contains(pairs[F.col("w.kind")], F.col("p.kind")))
    return near.select("row", "w").distinct().groupBy("row").agg(F.collect_list("w").alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    ``spans`` lists all findings as kind:start:end (code points, end exclusive) by start, the linked weak
    candidates among them; ``base_sha256`` is the digest of the list of strong findings alone. Null
    texts are empty and, like clean ones, have empty lists. Null ids and repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """
    scanned = _scanned(docs, id_col, text_col)
    joined = scanned.join(_linked(scanned), "row", "left").select("id", "strong", "linked")
    out = joined.mapInArrow(_digest, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


_SPAN = re.compile(r"(\w+):(\d+):(\d+)")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by its kind in angle brackets.

    All columns are kept, ``n_chars`` is brought up to date if there is one. Overlapping findings are
    replaced as one, under the first's kind. Rows keep their number, clean texts are unchanged.
    """
    text = F.col(text_col)
    found = scan_secrets(docs.select(F.xxhash64(text).alias("key"), text.alias("body")).dropDuplicates(["key"]), "key", "body")
    found = materialize(found.where("spans <> ''").select(F.col("key").alias("_key"), F.col("spans").alias("_spans")))

    def cover(batches):
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(text_col).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for kind, start, end in _SPAN.findall(spans):
                        start, end = int(start), int(end)
                        if start >= at:
                            parts += [body[at:start], f"<{kind}>"]
                        at = max(at, end)
                    body = "".join(parts) + body[at:]
                out.append(body)
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k).name, pa.array(out, batch.schema.field(k).type)).drop_columns(["_spans"])

    joined = docs.withColumn("_key", F.xxhash64(text)).join(found, "_key", "left").drop("_key")
    hit = materialize(joined.where("_spans IS NOT NULL").mapInArrow(cover, docs.schema))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return joined.where("_spans IS NULL").drop("_spans").unionByName(hit)
