"""The corpus pipeline: stages take effect, keep the columns, and leave clean documents alone."""

import hashlib

from pellucid.llm.common import materialize
from pellucid.llm.registry import vocabulary

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL))
        assert docs.columns == columns
        seen[name] = docs.count()
    assert 0 < seen["near_duplicates"] <= seen["toxicity"] <= 200 and seen["secrets"] == seen["near_duplicates"]
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected = sorted(hashlib.sha256(",".join(map(str, tokenizer.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest() for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r["ids_sha256"] for r in out.collect()) == expected


def test_null_and_repeated_ids(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(60)]
    copy, near = " ".join(base), [" ".join([f"own{k}", *base[1:]]) for k in range(3)]
    other = [" ".join(f"t{k}_{j}" for j in range(30)) for k in range(4)]
    rows = [(1, copy), (1, copy), (1, other[0]), (2, near[0]), (2, other[1]), (None, other[2]), (None, near[1]), (4, other[3]), (4, other[3])]
    rows = [(i, t, "en", "x", len(t)) for i, t in [*rows, (3, ""), (3, ""), (None, None)] for t in [t or ""]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    expected = [(1, copy), (1, other[0]), (2, other[1]), (None, other[2]), (4, other[3]), (3, ""), (3, ""), (None, "")]
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(expected, key=str)
    # a single source is taken whole: every row with words, once
    mixed = corpus_pipeline.mixing(spark, docs, SMALL)
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted((r for r in rows if r[1]), key=str)
