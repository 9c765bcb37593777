"""Regions and windows of pages against plain loops, layers against all boxes of a page."""

import math
import random

from pellucid.operators import regions, stacking

FRAGMENT = "page_id long, node_id int, ord int, region int, source string, boundary string, text string"


def _fragments(rng, pages, n):
    rows = []
    for page in range(pages):
        region, long_text = 0, rng.random() < 0.3
        at = 0
        for node in range(n):
            if rng.random() < (0.12 if page == 11 else 0.02 if page % 2 else 0.8):
                region = rng.randint(0, 5)
            sources = [s for s in ("text", "title", "alt") if rng.random() < (0.9 if s == "text" else 0.8 if page in (1, 11) else 0.1)] or ["text"]
            for source in sources:
                at += 1
                rows.append((page, node, at, region, source, rng.choice("pf"), "x" * rng.choice((1, 5, 3000 if long_text else 200))))
    return rows


def _regions(rows):
    out, by_page = {}, {}
    for page, node, _ord, region, *_, text in sorted(rows, key=lambda r: (r[0], r[2])):
        by_page.setdefault(page, {}).setdefault(node, [region, 0, 0])
        by_page[page][node][1] += 1
        by_page[page][node][2] += len(text)
    for page, nodes in by_page.items():
        made, chunks = [], {}
        for node, (region, n, chars) in nodes.items():
            last = made[-1] if made else None
            if not (last and last["region"] == region and last["c"] < 32 and last["n"] + n <= 64 and last["chars"] + chars <= 8192):
                chunks[region] = chunks.get(region, -1) + 1
                last = {"region": region, "c": 0, "n": 0, "chars": 0}
                made.append(last)
            out[page, node] = (len(made), chunks[region], last["c"]) if len(made) <= 200 else (None, None, None)
            last.update(c=last["c"] + 1, n=last["n"] + n, chars=last["chars"] + chars)
    return out


def _windows(rows, placed):
    by_region = {}
    for page, node, ord_, _, source, boundary, text in sorted(rows, key=lambda r: (r[0], r[2])):
        number, _, place = placed[page, node]
        if number is not None and number <= 80 and place < 16:
            by_region.setdefault(page, {}).setdefault(number, {}).setdefault(place, {})[source] = (boundary, len(text))
    out = set()
    for page, numbered in by_region.items():
        in_page = 0
        for number in sorted(numbered):
            places, in_region = numbered[number], 0
            for source in dict.fromkeys(s for p in sorted(places) for s in places[p]):
                for start in range(min(len(places) - 1, 16)):
                    taken = []
                    for place in range(start, min(start + 4, len(places))):
                        if source not in places[place] or sum(c for _, c in taken) + places[place][source][1] > 4096:
                            break
                        taken.append(places[place][source])
                        if len(taken) > 1 and in_region < 48 and in_page < 1000:
                            in_region, in_page = in_region + 1, in_page + 1
                            out.add((page, number, source, start, place, len(taken), sum(c for _, c in taken), sum(a[0] != b[0] for a, b in zip(taken, taken[1:]))))
    return out


def test_regions_and_windows_equal_a_plain_loop(spark):
    rows = _fragments(random.Random(3), 12, 420)
    frame = spark.createDataFrame(rows, FRAGMENT).repartition(5)
    placed = regions.page_regions(frame)
    expected = _regions(rows)
    assert {(r["page_id"], r["node_id"]): (r["region_nr"], r["chunk"], r["place"]) for r in placed.collect()} == expected
    assert any(v[0] is None for v in expected.values()) and any(v[1] for v in expected.values()) and any(v[2] == 31 for v in expected.values())
    got = [tuple(r) for r in regions.page_windows(frame, placed).collect()]
    assert set(got) == _windows(rows, expected) and len(got) == len(set(got))
    assert max(sum(g[0] == page for g in got) for page in range(12)) == 1000


def _click_captures(rows):
    up = lambda v: math.floor(v + 0.5)
    out = set()
    for page in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == page]
        seen = lambda r: (max(0.0, r[2]), max(0.0, r[3]), min(1280.0, r[2] + r[4]), min(720.0, r[3] + r[5]))
        for layer in own:
            left, top, right, bottom = seen(layer)
            _, node, *_, z, position, pointer, opacity, _t, _c = layer
            if position == "static" or not pointer or not (z >= 1 or opacity <= 0.35 or position == "fixed") or right - left < 32 or bottom - top < 24:
                continue
            ix, iy = max(4, up((right - left) * 0.25)), max(4, up((bottom - top) * 0.25))
            points = [(left + (right - left) / 2, top + (bottom - top) / 2), (left + ix, top + iy), (right - ix, top + iy), (left + ix, bottom - iy), (right - ix, bottom - iy)]
            for px, py in dict.fromkeys((min(max(0, up(x)), 1279), min(max(0, up(y)), 719)) for x, y in points):
                stack = sorted((r for r in own if r[8] and seen(r)[0] <= px < seen(r)[2] and seen(r)[1] <= py < seen(r)[3]), key=lambda r: (-r[6], -r[1]))
                target = next((r for r in stack if r[10] and r[1] != node), None)
                if stack and stack[0][1] == node and target:
                    out.add((page, node, target[1], px, py, "high" if target[11] and (z >= 20 or opacity <= 0.35) else "medium"))
                    break
    return out


def test_layers_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for page in range(25):
        for node in range(rng.randint(1, 60)):
            x, y = rng.uniform(-300, 1300), rng.uniform(-300, 760)
            wide, high = rng.choice(((1280.0, 720.0), (rng.uniform(0, 60), rng.uniform(0, 60)), (rng.uniform(10, 500), rng.uniform(10, 400)), (128.0, 128.0), (0.0, 50.0)))
            critical = rng.random() < 0.2
            rows.append((page, node, rng.choice((x, 0.0, 128.0)), rng.choice((y, 0.0, 256.0)), wide, high, rng.choice((0, 0, 1, 5, 20, 999)), rng.choice(("static", "fixed", "absolute", "sticky")), rng.random() < 0.9, rng.choice((0.1, 0.35, 1.0)), critical or rng.random() < 0.3, critical))
    columns = "page_id long, node_id int, x double, y double, width double, height double, z int, position string, pointer boolean, opacity double, is_target boolean, is_critical boolean"
    got = [tuple(r) for r in stacking.click_captures(spark.createDataFrame(rows, columns).repartition(4)).collect()]
    assert set(got) == _click_captures(rows) and len(got) == len(set(got)) > 20 and {g[5] for g in got} == {"high", "medium"}
    assert stacking.click_captures(spark.createDataFrame([], columns)).count() == 0
