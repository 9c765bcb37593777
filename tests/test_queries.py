"""Every SQL-expressible query against the other engine on the small tables, and cases of its parts."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

from pellucid.functions import punycode, unicode
from pellucid.functions.catalog import RULES, tokens
from pellucid.functions.dialect import Spark
from pellucid.operators.requests import observations
from pellucid.plans import jobs, oracles, queries
from pellucid.sources.html import page_rows
from pellucid.streaming.requests import rate_limited

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: int(v) if type(v).__name__ == "Decimal" else round(v, 6) if isinstance(v, float) else v
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    mine = queries.run(name, spark, SMALL)
    theirs = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert _sorted(mine.collect(), mine.columns) == _sorted(theirs.fetchall(), columns)


def _matches(text):
    padded = f" {tokens(text)} "
    hit = lambda group: any(f" {tokens(p)} " in padded for p in group[1])
    return {r.rule_id for r in RULES if all(map(hit, r.of("required"))) and not any(map(hit, r.of("forbidden")))}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.rule_id)
def test_each_rule_fires_on_its_own_phrases(rule):
    text = ". ".join(phrases[0] for _, phrases in rule.of("required"))
    assert rule.rule_id in _matches(text)
    for _, phrases in rule.of("forbidden"):
        for p in phrases:
            assert rule.rule_id not in _matches(f"{text}. {p}")


def test_apostrophes_protect():
    assert not _matches("Don't bypass security checks.")
    assert "safety-bypass.en.security-controls" in _matches("Bypass security checks.")


def test_catalog_has_eight_categories_in_two_languages():
    assert len(RULES) == 16 and len({r.category for r in RULES}) == 8


def test_normalize_and_words():
    assert unicode.normalize_text("  Ａ\t﻿b ") == "a b"
    assert unicode.words("don't api-ключ v1.2 foo_bar") == ["don't", "api", "ключ", "v1.2", "foo_bar"]
    assert unicode.decode_label("xn--80ak6aa92e") == "аррӏе" and unicode.decode_label("xn--\udc80") == "xn--\udc80"


def test_page_elements():
    rows = page_rows(1, "<div><p>Hi <b>you</b></p><script>x()</script><img alt='pic' title='pic'><textarea>no</textarea></div>")
    text = {(r[6], r[8]): r[7] for r in rows}
    assert text["p", "text"] == "Hi you" and text["script", "text"] is None and text["textarea", "text"] is None
    assert text["img", "title"] == "pic" and ("img", "alt") not in text
    assert page_rows(1, None) == []


def test_rate_limit_ignores_rejected(spark):
    log = spark.createDataFrame([(k, 1, k * 100) for k in range(130)], "seq long, sender long, now_ms long")
    allowed = [r["allowed"] for r in rate_limited(log).orderBy("seq").collect()]
    assert allowed[:20] == [True] * 20 and not any(allowed[20:100]) and allowed[100]


def test_rate_limit_keeps_senders_apart(spark):
    rows = [(k, k * k % 5, k * 137 % 60_000) for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["seq"]: r["allowed"] for r in rate_limited(spark.createDataFrame(rows, "seq long, sender long, now_ms long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    accepted = {}
    for seq, sender, now in sorted(rows, key=lambda r: (r[2], r[0])):
        held = [t for t in accepted.setdefault(sender, []) if t > now - 10_000]
        assert got[seq] == (len(held) < 20)
        if len(held) < 20:
            accepted[sender].append(now)


def test_stream_equals_batch(spark):
    stream = jobs.request_stream(spark, SMALL)
    text = "WITH events AS (SELECT * FROM parquet.`" + SMALL + "/events.parquet`) SELECT * FROM " + observations(Spark())
    batch = spark.sql(text).select(*stream.columns)
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))
    assert batch.count() > 0


@pytest.mark.parametrize("name", list(jobs.QUERIES))
def test_jobs_run(spark, name):
    assert jobs.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_without_training_data_operators(tmp_path):
    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "pellucid", tmp_path / "pellucid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    show = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for extra in ((), ("corpus_pipeline.py",)):
        for name in extra:  # the pipeline alone, without its operators, goes too
            if (root / name).exists():
                shutil.copy(root / name, tmp_path)
        run = subprocess.run([sys.executable, "-c", show], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert run.stdout.split() == [str(len(queries.QUERIES) + len(jobs.QUERIES)), str(len(queries.oracle_sql()) + len(oracles.ORACLES))]


def _encoded(host):
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in host.split("."))


def _unseeded_pages(spark, anchors):
    """A table of pages with one anchor each, of ids whose first anchor and base no seed replaces."""
    ids = [k for k in range(8, 19 * 40 * (1 + len(anchors)), 19) if k % 13 not in (1, 2, 3)]
    rows = [(k, "https://page.example:443/a/b", html) for k, html in zip(ids, anchors)]
    spark.createDataFrame(rows, "page_id long, url string, html string").createOrReplaceTempView("fixture_pages")
    return [r[0] for r in rows]


#: Host, then: mixed scripts, one look-alike script throughout, a look-alike letter in Latin, a script foreign to the zone.
HOSTS = [
    ("сахар.рф", 0, 0, 0, 0), ("www.сахар.рф", 0, 0, 0, 0), ("пример.рф", 0, 0, 0, 0), ("оса.com", 0, 0, 0, 1), ("рос.net", 0, 0, 0, 1),
    ("аррӏе.com", 0, 1, 0, 1), ("ѕсоре.com", 0, 1, 0, 1), ("раураӏ.net", 0, 1, 0, 1), ("gogleɟ.com", 0, 0, 1, 1), ("paypᴀl.com", 0, 0, 1, 1), ("ɡoogle.com", 0, 0, 1, 1),
    ("münchen.de", 0, 0, 0, 1), ("łódź.pl", 0, 0, 0, 1), ("ελλάδα.gr", 0, 0, 0, 1), ("shop.example.com", 0, 0, 0, 0), ("pаypal.com", 1, 0, 0, 1), ("中国.рф", 0, 0, 0, 1),
]


def test_hosts_are_judged_in_their_characters(spark):
    _unseeded_pages(spark, [f'<a href="https://{h}/x">t</a>' for host, *_ in HOSTS for h in {host, _encoded(host)}])
    rows = spark.sql("WITH pages AS (SELECT * FROM fixture_pages) " + queries.QUERIES["l17_host_analysis"](Spark())).collect()
    got = {r["host"]: tuple(int(r[c]) for c in ("mixed_script", "whole_script", "latin_lookalike", "zone_mismatch")) for r in rows}
    for host, *flags in HOSTS:
        assert got[host] == got[_encoded(host)] == tuple(flags), host
    assert "page.example" in got


def test_relative_targets_follow_the_base_element(spark):
    ids = _unseeded_pages(spark, [
        '<base href="https://evil.example:8443/x/"><a href="/login">t</a>', '<base href="https://page.example/z/"><a href="login">t</a>',
        '<base href="/docs/"><a href="?q=1">t</a>', '<base href="//other.example/"><a href="HTTPS://user@Named.example:90/a">t</a>', '<a href="b">t</a>',
    ])
    run = lambda name: spark.sql("WITH pages AS (SELECT * FROM fixture_pages) " + queries.QUERIES[name](Spark())).collect()
    assert {r["page_id"]: r["host"] for r in run("l03_base_resolution")} == dict(zip(ids, ["evil.example", "page.example", "page.example", "named.example", "page.example"]))
    assert {r["page_id"]: r["base_origin"] for r in run("l04_foreign_base")} == {ids[0]: "https://evil.example:8443", ids[3]: "https://other.example"}


def test_labels_decode_as_the_codec_does(spark):
    alphabet = "abcdeаеорсхжαρνü漢字日ᴀ-x😀"
    words = {"".join(alphabet[(k * 7 + j * j * (k % 5 + 1)) % len(alphabet)] for j in range(k % 13 + 1)) for k in range(200)}
    labels = ["xn--" + w.encode("punycode").decode() for w in words if not w.isascii()]
    labels += ["xn--99999999999999999999999999999999999", "xn--zzzzzzzzzzz", "xn--abc!", "abc", "", "xn--80ak6aa92e"]
    spark.createDataFrame([(x,) for x in labels], "label string").createOrReplaceTempView("fixture_labels")
    for r in spark.sql(f"SELECT label, {punycode.decoded(Spark(), 'label')} AS decoded FROM fixture_labels").collect():
        assert r["decoded"] == unicode.decode_label(r["label"])


def test_captions_are_the_links_own_and_name_hosts_of_real_zones(spark):
    shown = [
        ("<b>shop</b>.example.com &amp; more", "shop.example.com"), ("torch.nn", None), ("os.fn", None), ("bank.de", "bank.de"), ("archive.zip", None), ("сайт.рф", "сайт.рф"), ("site.uk", "site.uk"), ("no host", None),
    ]
    ids = _unseeded_pages(spark, [f'<p>x</p><a class="k" href="https://real.example/a">{c}</a> after.com' for c, _ in shown])
    run = lambda name: spark.sql("WITH pages AS (SELECT * FROM fixture_pages) " + queries.QUERIES[name](Spark())).collect()
    named = {r["page_id"]: r["named"] for r in run("l22_plausible_tld") if r["plausible_tld"]}
    assert named == {k: host for k, (_, host) in zip(ids, shown) if host}


def test_opaque_destinations(spark):
    import base64

    told = lambda text: base64.urlsafe_b64encode(text.encode()).decode()
    cases = [
        ("evil.com", "bare"), ("torch.nn", None), ("archive.zip", None), ("a%2525252f", None), ("x%253A%252F%252Fevil", "encoded"), (told("https://evil.io/long"), "base64"), (told("https://evil.io/lo").rstrip("="), "base64"),
        (told("just some words here"), None), ("abcdefghijklmnopqrst", None), ("user@evil.com", None), ("short", None),
    ]
    ids = _unseeded_pages(spark, [f'<a href="https://page.example/go?url={dest}">t</a>' for dest, _ in cases])
    rows = spark.sql("WITH pages AS (SELECT * FROM fixture_pages) " + queries.QUERIES["l08_opaque_signals"](Spark())).collect()
    got = {r["page_id"]: next((k for k in ("encoded", "bare", "base64") if r[{"encoded": "encoded_url", "bare": "bare_hostname", "base64": "base64_url"}[k]]), None) for r in rows}
    assert got == {k: sign for k, (_, sign) in zip(ids, cases)}
