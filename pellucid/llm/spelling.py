"""Spelling variants: words one edit apart, found by products of letter counts, and the form each belongs to.

Words are vectors of letter counts. One inserted or deleted letter moves a vector by a squared distance of 1,
one replaced letter by 2, so near words have vectors at most 2 apart and lengths at most one apart. Words
are laid in blocks by length and by how many of their letters fall in each of a few letter classes: an edit
changes these counts by one at most, so a block meets itself and a fixed number of adjacent blocks alone. For
each such pair of blocks one matrix product (the Gram matrix) gives all squared distances, and pairs within
2 are verified as edits. Nothing is left out: a block of any size is split into parts of bounded size, and all
parts of adjacent blocks meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import materialize

#: What a word is made of: ASCII letters and the upper half of Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
_LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
#: Letters fall in ``CLASSES + 1`` classes by code point; the first ones are counted, the last is what is left.
CLASSES = 4
#: Words in a part of a block, and letters in it, at most.
PART_WORDS, PART_LETTERS = 1024, 1 << 22


def _without(word: str, at: str) -> F.Column:
    """The word without the code point at an index from 0."""
    return F.expr(f"concat(substring({word}, 1, {at}), substring({word}, {at} + 2))")


def spelling_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``(word, n)``: the runs of letters in all whole texts, counted over the table.

    A-Z are lower-cased, other letters stay. Where ``modulus`` divides the crc32 of ``<id>:<run>``, the run loses the
    code point at crc32 % length. Missing texts have no words; a missing id is an empty string there.
    """
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", upper, lower).alias("run"), F.length("run").alias("len")).where(f"len >= {least_length}")
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    words = runs.select(F.when(F.expr(f"h % {modulus} = 0"), _without("run", "CAST(h % len AS INT)")).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _blocks(words: DataFrame) -> DataFrame:
    """The words by block: ``len``, ``classes`` (letters of each counted class), ``part``, and lists of bounded length."""
    classes = ["".join(c for c in _LETTERS if ord(c) % (CLASSES + 1) == k) for k in range(CLASSES)]
    counts = [(F.length("word") - F.length(F.translate("word", letters, ""))).alias(f"c{k}") for k, letters in enumerate(classes)]
    key = ["len", *(f"c{k}" for k in range(CLASSES))]
    rows = words.select("word", "n", F.length("word").alias("len"), *counts)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, key)
    most = f"greatest(1, least({PART_WORDS}, {PART_LETTERS} div len))"
    part = F.expr(f"CAST(pmod(xxhash64(word), (size + {most} - 1) div {most}) AS INT)")
    lists = rows.groupBy(*key, part.alias("part")).agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return lists.select("len", F.array(*key[1:]).alias("classes"), "part", F.col("words.word").alias("words"), F.col("words.n").alias("ns"))


def _steps() -> list[tuple[int, list[int]]]:
    """From a block to those that an edit may lead to, each pair of blocks once: what is added to length and classes."""
    unit = lambda k: [int(j == k) for j in range(CLASSES)]  # noqa: E731  the last class is not counted
    steps = [(0, [0] * CLASSES)]
    steps += [(0, [a - b for a, b in zip(unit(i), unit(j), strict=True)]) for i in range(CLASSES + 1) for j in range(i + 1, CLASSES + 1)]
    return steps + [(1, unit(i)) for i in range(CLASSES + 1)]


_COLUMN_OF = np.zeros(256, dtype=np.int64)
_COLUMN_OF[[ord(c) for c in _LETTERS]] = range(len(_LETTERS))


def _codes(words: list[str]) -> np.ndarray:
    """One row of code points for each of some words of one length, which Latin-1 holds."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    rows, width = len(codes), len(_LETTERS)
    cells = np.bincount((np.arange(rows)[:, None] * width + _COLUMN_OF[codes]).ravel(), minlength=rows * width)
    # counts and their products are whole numbers, exact in 32 bits up to words of 2,000 letters
    return cells.reshape(rows, width).astype(np.float32 if codes.shape[1] <= 2000 else np.float64)


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``b`` is the row of ``a`` with one letter replaced, or inserted if it is one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + behind >= a.shape[1]


def near_in_blocks(left: list[str], right: list[str], same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of two lists that are one edit apart; each list holds one length, the right one's the same or one more.

    same: both lists are one, and each pair is wanted once.
    """
    a, b = _codes(left), _codes(right)
    x, y = _letter_counts(a), _letter_counts(b)
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squares <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    # verified in steps, as long words may have many anagrams
    step = max(1, PART_LETTERS // max(1, b.shape[1]))
    good = [_edits(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
    return i[good], j[good]


def _near(batches):
    for batch in batches:
        for row in batch.to_pylist():
            i, j = near_in_blocks(row["words"], row["others"], row["same"])
            if len(i):
                left, right = pa.array(row["words"]).take(pa.array(i)), pa.array(row["others"]).take(pa.array(j))
                n, m = pa.array(row["ns"], pa.int64()).take(pa.array(i)), pa.array(row["ms"], pa.int64()).take(pa.array(j))
                yield pa.RecordBatch.from_arrays([left, right, m], names=["word", "other", "n"])
                yield pa.RecordBatch.from_arrays([right, left, n], names=["word", "other", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """``(word, other, n)``: all pairs one edit apart, both ways, with the other word's count. ``words``: distinct ``(word, n)``."""
    blocks = materialize(_blocks(words))
    steps = F.array(*(F.struct(F.lit(n).alias("longer"), F.array(*map(F.lit, c)).alias("moved")) for n, c in _steps()))
    left = blocks.select("len", "classes", F.col("part").alias("own"), "words", "ns", F.explode(steps).alias("step"))
    left = left.select(
        (F.col("len") + F.col("step.longer")).alias("len"), F.zip_with("classes", "step.moved", lambda a, b: a + b).alias("classes"), "own", "words", "ns",
        F.forall("step.moved", lambda m: m == 0).alias("level") & (F.col("step.longer") == 0),
    ).toDF("len", "classes", "own", "words", "ns", "inside")
    right = blocks.select("len", "classes", "part", F.col("words").alias("others"), F.col("ns").alias("ms"))
    pairs = left.join(right, ["len", "classes"]).where("NOT inside OR own <= part")
    pairs = pairs.select("words", "ns", "others", "ms", (F.col("inside") & (F.col("own") == F.col("part"))).alias("same"))
    return pairs.mapInArrow(_near, "word string, other string, n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: forms are followed to the last, twice as far in each round."""
    hops = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        hops = materialize(hops.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.drop("moved")


def spelling_variants(words: DataFrame) -> DataFrame:
    """For distinct words with their counts ``(word, n)``: their near words, form and root.

    A word's form is its near word of the largest count, among equals the smallest in code-point order, if that
    count is at least twice its own. Counts grow along forms, so they lead to a root without turning back.
    Words may be of any length and any letters of ``RUN`` in lower case; an empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    chosen = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all whole texts and their spelling variants: ``word, form, root, n, n_near, form_n``.

    Null and empty texts have no words, very long ones count like others; repeated rows count as often as they
    appear; other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    return spelling_variants(spelling_words(docs, id_col, text_col))
