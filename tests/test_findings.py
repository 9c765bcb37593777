"""Findings of split instructions as they are merged, committed and retracted, and the gates of the serving interface."""

import json
import random

from pellucid.operators.rollup import _frames
from pellucid.functions.dialect import Spark
from pellucid.streaming import findings
from pellucid.streaming.requests import gated

DECISION = "conv_id long, run long, chunk long, turn int, size int, path int, ord int, source_type string, action_group string, rule_id string, confidence long, severity long, contributing array<int>, spans array<struct<candidate:int>>, eligible boolean"


def _decisions(rng, n):
    rows = []
    for k in range(n):
        turn, size, path = rng.randint(0, 12), rng.randint(2, 4), rng.randint(1, 3)
        group = rng.choice("AB")
        own = list(range(turn, turn + size))
        rows.append((rng.randint(1, 6), rng.randint(1, 2), 0, turn, size, path, k, rng.choice(("text", "title")), group, f"{group}{k % 3}", rng.randint(1, 3), rng.randint(1, 3), own[: rng.choice((1, size, size))], [(c,) for c in own], rng.random() < 0.9))
    return rows


def _merged(rows):
    """The fold as it is told: in order, into the first finding that shares a candidate, unless that has no room."""
    pending = {}
    for conv, run, chunk, _turn, _size, path, _ord, source, group, rule, confidence, severity, contributing, spans, eligible in sorted(rows, key=lambda r: (r[:3], r[3], r[4], r[5], r[6])):
        own = {s[0] for s in spans}
        if not eligible or len(contributing) < 2:
            continue
        holders = pending.setdefault((conv, run, chunk), [])
        old = next((h for h in holders if (h["source"], h["group"]) == (source, group) and h["own"] & own), None)
        new = {"source": source, "group": group, "rule": rule, "rank": (confidence, severity, -path), "own": own, "contributing": set(contributing), "n": 1}
        if old is None:
            holders.append(new)
        elif len(old["own"] | own) <= 8 and len(old["contributing"] | set(contributing)) <= 8:
            best = new if new["rank"] > old["rank"] else old
            old.update(rule=best["rule"], rank=best["rank"], own=old["own"] | own, contributing=old["contributing"] | set(contributing), n=old["n"] + 1)
    return sorted((*region, h["source"], h["group"], h["rule"], *h["rank"][:2], -h["rank"][2], sorted(h["own"]), sorted(h["contributing"]), h["n"]) for region, hs in pending.items() for h in hs)


def test_decisions_merge_in_order(spark):
    for seed in range(3):
        rows = _decisions(random.Random(seed), 250)
        got = findings.merge_decisions(spark.createDataFrame(rows, DECISION).repartition(5)).collect()
        assert sorted(map(tuple, got)) == _merged(rows)
        assert any(len(g["candidates"]) == 8 for g in got) and any(g["n_decisions"] > 2 for g in got)


def _finding(rng):
    at = rng.randint(0, 6)
    return {"region": [rng.randint(1, 3), 0], "source_type": "text", "action_group": rng.choice("AB"), "rule_id": rng.choice("xy"), "confidence": 2, "severity": 2, "path": 1, "candidates": list(range(at, at + rng.randint(2, 3))), "contributing": [at, at + 1]}


def _events(rng, pages, n):
    rows = []
    for page in range(pages):
        for seq in range(1, n + 1):
            scope = rng.choice(("full", "region", "region", "remove"))
            own, seen = [], set()
            for f in (_finding(rng) for _ in range(rng.randint(0, 4))):
                if (key := (f["region"][0], f["action_group"], tuple(f["candidates"]))) not in seen:
                    seen.add(key)
                    own.append(f)
            rows.append((page, seq, scope, [[rng.randint(1, 3), 0]], rng.random() < 0.3, [rng.randint(0, 8)], json.dumps(own)))
    return rows


_EVENT = "conv_id long, seq long, scope string, regions array<array<long>>, partial boolean, candidates array<int>, findings string"


def _replayed(rows):
    """Every page recomputed from plain lists of findings."""
    out, pages = [], {}
    for page, seq, scope, regions, partial, candidates, told in sorted(rows, key=lambda r: r[:2]):
        active, revision, was_partial = pages.get(page, ([], 0, False))
        content = lambda fs: sorted(json.dumps(f, sort_keys=True) for f in fs)
        if scope == "remove":
            kept = [f for f in active if not set(f["candidates"]) & set(candidates)]
            changed = len(kept) < len(active)
        else:
            new = json.loads(told)
            kept = [] if scope == "full" and not partial else [f for f in active if partial or f["region"] not in regions]
            same = lambda f, g: all(f[k] == g[k] for k in ("region", "action_group", "source_type", "candidates"))
            kept = [next((n for n in new if same(n, f)), f) for f in kept] + [n for n in new if not any(same(n, f) for f in kept)]
            changed, was_partial = content(kept) != content(active), partial
        revision += changed
        pages[page] = kept, revision, was_partial
        out.append((page, seq, "partial" if was_partial else "complete", len(kept), revision, changed))
    return out


def test_revisions_equal_a_recomputation(spark):
    rows = _events(random.Random(1), 12, 25)
    got = findings.revisions(spark.createDataFrame(rows, _EVENT).repartition(4)).collect()
    assert sorted(map(tuple, got)) == _replayed(rows)
    assert {g["status"] for g in got} == {"partial", "complete"} and {g["changed"] for g in got} == {True, False}


def test_stream_equals_batch_after_each_micro_batch(spark, tmp_path):
    rows = _events(random.Random(2), 5, 12)
    source = f"file://{tmp_path}/events"
    for seq in range(1, 13, 2):  # two events of each page in a file, a file in a micro-batch
        spark.createDataFrame([r for r in rows if r[1] in (seq, seq + 1)], _EVENT).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(_EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    query = findings.revision_stream(events).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 6
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("conv_id", "seq", "status", "active", "revision", "changed").collect())) == _replayed(rows)


def test_limits_of_a_page():
    page = findings.PageFindings()
    own = [{**_finding(random.Random(0)), "candidates": [k, k + 1, k + 2, k + 3], "region": [k, 0]} for k in range(300)]
    assert page.commit(1, "full", [], False, own[:150]) and len(page.active) == 150 and not page.partial
    keys = list(page.active)
    assert page.commit(2, "full", [], False, own) and len(page.active) == 200 and page.partial and list(page.active)[:150] == keys
    assert not findings.PageFindings(page.saved()).commit(3, "full", [], False, list(map(dict, own[:200])))
    # the index holds 1,000 entries, five for each finding here, so all candidates are known
    assert page.remove([199]) and set(page.active) == {k for k in keys + list(range(151, 201)) if not 199 in page_candidates(own, k)}


def page_candidates(own, key):
    return own[key - 1]["candidates"]


def test_refused_calls_do_not_count(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice((1, 2, 3, None)), k * rng.choice((60, 61)), rng.random() < 0.1, rng.choice(("hello", "get-findings", "purge", None)), rng.choice((None, 1, 2)), rng.random() < 0.8) for k in range(2000)]
    got = {r["seq"]: r["gate"] for r in gated(spark.createDataFrame(rows, "seq long, sender long, now_ms long, from_page boolean, action string, tab_id int, in_front boolean"), [1, 2]).collect()}
    accepted, expected = {}, {}
    for seq, sender, now, page, action, tab, front in sorted(rows, key=lambda r: (r[2], r[0])):
        if sender not in (1, 2):
            expected[seq] = "allowlist"
        elif page:
            expected[seq] = "page"
        elif action not in ("hello", "get-findings"):
            expected[seq] = "action"
        else:
            held = [t for t in accepted.get(sender, []) if t > now - 10_000]
            if len(held) >= 20:
                expected[seq] = "rate"
                continue
            accepted[sender] = [*held, now]
            expected[seq] = "ok" if action == "hello" else "front" if not front else "tab" if tab not in (None, 1) else "ok"
    assert got == expected and set(got.values()) == {"allowlist", "page", "action", "rate", "front", "tab", "ok"}


def test_frames_replace_or_add_up(spark):
    rows = [(1, "view", 40, 0), (2, "view", 40, 1), (5, "view", 40, 0), (7, "view", 40, 0), (8, "view", 80, 0)]
    spark.createDataFrame([(k, kind, user) for k, kind, user, _ in rows], "event_id long, event_type string, user_id long").createOrReplaceTempView("fixture_events")
    got = spark.sql("WITH events AS (SELECT * FROM fixture_events) " + _frames(Spark())).collect()
    # all on page 0: frame 1 reports 1 and, late, 7 % 4; frame 2 reports 2, then 1, then 0
    assert [tuple(r) for r in got] == [(0, 2, 1, 7, 1, False, "issues")]
