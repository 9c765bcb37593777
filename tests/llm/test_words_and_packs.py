"""Spelling variants, packing and the filter audit against brute-force versions, on small fixtures."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from pellucid.llm import cutting_stock, filter_audit, spelling
from pellucid.llm.packing import pack_documents
from pellucid.llm.radix_trie import RadixTrie, common_prefix
from pellucid.llm.registry import queries, vocabulary

SMALL = "/root/testdata/sf0.001"
LOREM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
#: Null, empty, blank, very long, repeated and null-id rows, ties of texts under several ids.
EDGES = [
    (1, "a b c", "x"), (2, None, None), (3, "", "y"), (4, " \t\n", "y"), (5, "A B C", "x"), (5, "A B C", "x"), (None, "a b c", "x"), (None, "", ""),
    (6, "token = 'abcdefgh12' q" + " w" * 30_000, "z"), (7, "é 日本  <|endoftext|>x\x1cy", None), (8, LOREM, "x"), (9, LOREM, "x"), (10, LOREM[: len(LOREM) // 2], "x"),
    (11, "colour color coloor ÀBCDÉ àbcdé straße " * 40, "x"), (12, "x" * 1_200_000 + " yyyyyy", "long"), (13, "a b c", None),
]


@pytest.fixture(scope="module")
def edges(spark):
    # other columns, with names that operators use themselves
    rows = [(*r, "n", 1, "z", 3, 7, "w") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string, n int, id string, row int, mask int, word string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def _rows(df):
    return [(r[0], r[1] or "", r[2]) for r in df.select("doc_id", "text", "source").collect()]


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _expected_words(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for key, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _expected_variants(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_length[len(w) + d] if _near(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def _variants(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_variants_are_exact(spark, docs, edges):
    expected = _expected_variants(_expected_words(_rows(docs)))
    assert len(expected) > 300 and any(form and root != form for _, form, root, *_ in expected)
    assert _variants(queries()["op11_spelling_variants"](spark, SMALL)) == expected
    assert _variants(spelling.spelling_groups(edges)) == _expected_variants(_expected_words(_rows(edges)))
    assert spelling.spelling_groups(edges.where("false")).count() == 0


def test_chains_of_forms_and_blocks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 7)
    rng, counts = random.Random(3), {}
    for k in range(9):  # each form leads to the next
        counts["a" * 9 + "bcdefghij"[:k] + "z" * 3] = 3 * 2**k
    while len(counts) < 400:
        counts["".join(rng.choice("abé") for _ in range(rng.randint(5, 8)))] = rng.randint(3, 40)
    got = _variants(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == _expected_variants(counts)


@pytest.mark.parametrize("lengths", [(1, 4096), (900, 1800), (300, 2100), (1, 9), (4096, 4097)])
def test_patterns_use_up_all_pieces(lengths):
    widths = cutting_stock.width_classes(4096)
    counts = np.bincount(np.searchsorted(widths, np.random.default_rng(1).integers(*lengths, 5000)), minlength=len(widths))
    found = cutting_stock.packing_patterns(widths, counts, 4096)
    assert (sum(p * k for p, k in found) == counts).all() and all(p @ widths <= 4096 for p, _ in found)
    n, greedy = sum(k for _, k in found), sum(k for _, k in cutting_stock._greedy(widths, counts, 4096))
    assert widths @ counts / 4096 <= n <= greedy + 1


def test_column_generation_beats_largest_first():
    widths = np.array([900, 1100, 1300, 1400, 1700])
    counts = np.array([200, 150, 170, 120, 90])
    found = sum(k for _, k in cutting_stock.packing_patterns(widths, counts, 4096))
    assert found < sum(k for _, k in cutting_stock._greedy(widths, counts, 4096))
    pattern = cutting_stock.best_patterns(widths, np.array([1.0, 1.3, 1.5, 1.7, 2.1]), 4096)
    every = [(a, b, c, d, e) for a in range(5) for b in range(4) for c in range(4) for d in range(3) for e in range(3) if 900 * a + 1100 * b + 1300 * c + 1400 * d + 1700 * e <= 4096]
    price = lambda p: p @ np.array([1.0, 1.3, 1.5, 1.7, 2.1])
    assert price(pattern[:, 0]) == pytest.approx(max(price(np.array(p)) for p in every))
    for k in range(5):
        assert price(pattern[:, k + 1]) == pytest.approx(max(price(np.array(p)) for p in every if p[k])) and pattern[k, k + 1]


def _padding(pieces):
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    return sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values()), sum(used.values())


def _check_packing(pieces, rows, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    expected = defaultdict(list)
    for key, text, _ in rows:
        expected[key, len(ids_of(text))].append(ids_of(text))
    assert set(by_doc) == set(expected)
    for key, found in by_doc.items():
        for ids in {tuple(x) for x in expected[key]}:
            raw = np.array(ids, dtype="<u4")
            right = [r for r in found if zlib.crc32(raw[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
            assert {k for r in right for k in range(r["start"], r["start"] + r["length"])} == set(range(len(ids)))
        assert sum(r["length"] for r in found) == sum(map(len, expected[key])) and all(r["length"] > 0 for r in found)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_packing(spark, docs, edges, ids_of):
    pieces = queries()["op12_pack_sequences"](spark, SMALL).collect()
    _check_packing(pieces, _rows(docs), ids_of)
    padding, total = _padding(pieces)
    assert padding <= 0.03 * total
    _check_packing(pack_documents(edges, vocabulary("word_bpe_49k.json")).collect(), _rows(edges), ids_of)
    assert pack_documents(edges.where("false"), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("same", [1, 16, 200, 4095])
def test_packing_of_one_common_length(spark, ids_of, same):
    """Two thirds of all rows have one length; all of them fit, and little is padded."""
    rows = [(k, "a " * (same - 1 if k % 3 else k % 701), "x") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = pack_documents(frame, vocabulary("word_bpe_49k.json")).collect()
    _check_packing(pieces, rows, ids_of)
    padding, total = _padding(pieces)
    assert padding <= 0.02 * total + 4096


def test_radix_trie():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() * rng.choice((1, 1, 40)) for _ in range(2000)]
    trie = RadixTrie()
    for k, t in enumerate(texts):
        trie.insert(t, None if k % 11 == 0 else (k * 37) % 2000, k)
    expected = defaultdict(list)
    for k, t in enumerate(texts):
        expected[t].append(k)
    found = {t: (least, items) for t, least, items in trie.terminals()}
    assert {t: items for t, (_, items) in found.items()} == expected
    for t, (least, items) in found.items():
        assert least == min(((k * 37) % 2000 for k in items if k % 11), default=None)
    assert common_prefix(b"abc", b"abd") == 2 and common_prefix(b"", b"x") == 0 and common_prefix(b"ab", b"abc") == 2


def _expected_audit(rows, labels):
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text] = min(least.get(text, key), key)
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    counts = Counter()
    for key, text, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (key is not None and key > least[text])
        counts[part or "", fails, key in good, key in toxic] += 1
    shapley, out = Counter(), {}
    for order in map("".join, permutations("ABCDE")):
        for (part, fails, is_good, is_toxic), n in counts.items():
            first = next((f for f in order if f in fails), None)
            for step, f in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                gone = any(x in fails for x in order[: step - 1])
                row[0] += n * (not gone and f not in fails)
                row[1] += n * (f == first)
                row[2] += n * (gone and f in fails)
                row[3] += n * (fails == f)
                row[4] += n * (f == first and is_good)
                row[5] += n * (f == first and is_toxic)
            if first:
                shapley[part, first] += n
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audit(df):
    return {tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_filter_audit(spark, docs, edges, labels, monkeypatch):
    assert _audit(queries()["op13_filter_audit"](spark, SMALL)) == _expected_audit(_rows(docs), labels.collect())
    odd = labels.union(spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, 1)], "doc_id long, quality long, toxic long").select(*labels.columns))
    expected = _expected_audit(_rows(edges), odd.collect())
    for size in (1 << 24, 1, 3000):  # tries that are dropped after each text as well
        monkeypatch.setattr(filter_audit, "TRIE_BYTES", size)
        assert _audit(filter_audit.filter_audit(edges, odd)) == expected
    assert filter_audit.filter_audit(edges.where("false"), odd).count() == 0


def test_copies_across_ranges_and_tasks(spark, labels):
    """A third of the rows share a text, families share long prefixes, and ids are dealt over many tasks."""
    rng = random.Random(2)
    family = "long shared passage " * 150
    rows = [(k, "one text for all" if k % 3 == 0 else family + str(rng.randint(0, 150)) if k % 3 == 1 else str(rng.randint(0, 300)), "s") for k in rng.sample(range(5000), 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(11)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = _audit(filter_audit.filter_audit(frame, labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == _expected_audit(rows, labels.collect())


def test_ids_by_distinct_words(ids_of):
    import pyarrow as pa

    from pellucid.llm.bpe import PieceEncoder
    from pellucid.llm.word_ids import encode_texts

    rng = random.Random(1)
    texts = [None, "", "  ", " a  b\n\nc ", "don't 'S I'll x's", "é日本  <|endoftext|>x\x1cy", "A" * 100 + " b" + "!" * 60, "Ça va? été!!! -- a_b 12,3   x﻿", "a b c\u0085d e", LOREM.upper()]
    texts += ["".join(rng.choice("abéÉ ,.!'’\n12日́ 　\x1d\t\x0b") for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    encoder = PieceEncoder(vocabulary("word_bpe_49k.json"), True)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        flat, edges = encode_texts(encoder, pa.array(part, pa.string()))
        for k, t in enumerate(part):
            assert flat[edges[k] : edges[k + 1]].tolist() == ids_of(t or "")[:-1]
    assert encode_texts(encoder, pa.array([], pa.string()))[1].tolist() == [0]
