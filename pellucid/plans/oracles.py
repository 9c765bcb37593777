"""SQL of the checking engine for jobs whose Spark side is no SQL: written apart from it, over the same tables."""

from __future__ import annotations

from pellucid.functions.catalog import RULES, tokens
from pellucid.functions.dialect import Duck, values
from pellucid.operators.semantic import TOKEN
from pellucid.operators.splitting import regions
from pellucid.sources.seeds import CONTEXT_SEEDS, LITERAL_SEEDS, seeded_calls, seeded_docs, seeded_elements, seeded_requests

_D = Duck()


def _alternatives() -> str:
    rows = [
        (k, r.rule_id, r.action_group, r.primary, len(r.of("required")), kind, signal, place, tokens(phrase))
        for k, r in enumerate(RULES) for kind in ("required", "optional", "forbidden") for signal, phrases in r.of(kind) for place, phrase in enumerate(phrases)
    ]
    return values("ord, rule_id, action_group, is_primary, n_required, kind, signal_id, place, phrase", rows, _D)


def _segments() -> str:
    """CTEs ending in ``seg``: each step finds the next segment from where the last one ended."""
    sentence_end = "list_min(list_filter(s.ends, lambda e: e > {pos}))"
    break_at = "coalesce(list_max(list_filter(range({raw}, {pos} + 3840, -1), lambda k: regexp_matches(substring(s.text, k, 1), '[\\s.,;:!?]'))), {raw})"

    def step(pos: str, lim: str, frm: str) -> str:
        limit = f"coalesce({lim}, CASE WHEN {sentence_end.format(pos=pos)} - {pos} > 4096 THEN {sentence_end.format(pos=pos)} END)"
        raw = f"least(limited, {pos} + 4096)"
        stop = f"""CASE WHEN limited IS NULL THEN list_max(list_filter(s.ends, lambda e: e <= {pos} + 4096))
            WHEN {raw} = limited THEN {raw} ELSE {break_at.format(raw=raw, pos=pos)} END"""
        return f"""SELECT s.doc_id, s.text, s.n, s.ends, s.segment, s.pos, s.limited, {stop} AS stop FROM (SELECT {frm}, {limit} AS limited) s"""

    first = step("s.pos", "NULL", "*").replace("(SELECT *, ", "(SELECT s.*, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS pos, ").replace(" AS limited) s", " AS limited FROM long_ones s) s")
    first = first.replace("lambda e: e > s.pos))", "lambda e: e > 0))").replace("- s.pos > 4096 THEN", "- 0 > 4096 THEN")
    after = "CASE WHEN x.limited IS NULL OR x.stop = x.limited THEN x.stop ELSE greatest(x.stop - 256, x.pos + 1) END"
    kept = "CASE WHEN x.limited IS NOT NULL AND x.stop < x.limited THEN x.limited END"
    moved = f"(SELECT x.doc_id, x.text, x.n, x.ends, x.segment + 1 AS segment, {after} AS pos, {kept} AS kept FROM walk x WHERE x.stop < x.n)"
    again = step("s.pos", "s.kept", "*").replace("(SELECT *, ", "(SELECT s.*, ").replace(" AS limited) s", f" AS limited FROM {moved} s) s")
    return f"""docs AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM {seeded_docs(_D)} q WHERE text IS NOT NULL),
        pieces AS (SELECT *, list_transform(regexp_extract_all(text, '(?s).*?[.!?]\\s+'), lambda x: length(x)) AS sizes FROM docs WHERE n > 4096),
        long_ones AS (SELECT doc_id, text, n, list_distinct(list_append(list_transform(range(1, len(sizes) + 1), lambda k: CAST(list_sum(sizes[1:k]) AS BIGINT)), n)) AS ends FROM pieces),
        walk AS ({first} UNION ALL {again}),
        seg AS (SELECT doc_id, segment, pos AS start, stop, text FROM walk UNION ALL SELECT doc_id, 0, 0, n, text FROM docs WHERE n <= 4096)"""


def _evidence(source: str, keys: str) -> str:
    """CTEs ending in ``ev``: rules that hold in the rows of ``source`` (keys, ``text``), a row per required signal with its place."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""tk AS (SELECT *, regexp_extract_all(text, '{TOKEN}') AS toks, regexp_split_to_array(text, '{TOKEN}') AS seps FROM {source} x),
        pd AS (SELECT *, ' ' || array_to_string(list_transform(toks, lambda t: lower(t)), ' ') || ' ' AS padded FROM tk),
        hit AS (SELECT pd.*, p.*, instr(padded, ' ' || phrase || ' ') AS seen FROM pd JOIN {_alternatives()} p ON contains(padded, ' ' || p.phrase || ' ')),
        nth AS (SELECT *, length(padded[1:seen - 1]) - length(replace(padded[1:seen - 1], ' ', '')) AS f, len(string_split(phrase, ' ')) AS w FROM hit),
        spot AS (SELECT *, list_sum(list_transform(seps[1:f + 1], lambda t: length(t))) + coalesce(list_sum(list_transform(toks[1:f], lambda t: length(t))), 0) AS start,
            list_sum(list_transform(seps[1:f + w], lambda t: length(t))) + list_sum(list_transform(toks[1:f + w], lambda t: length(t))) AS stop FROM nth),
        one AS (SELECT {keys}, ord, rule_id, action_group, is_primary, n_required, kind, signal_id, arg_min(start, place) AS start, arg_min(stop, place) AS stop FROM spot GROUP BY ALL),
        held AS (SELECT {keys}, rule_id FROM one GROUP BY {keys}, rule_id, n_required HAVING sum(CASE WHEN kind = 'required' THEN 1 ELSE 0 END) = n_required AND sum(CASE WHEN kind = 'forbidden' THEN 1 ELSE 0 END) = 0),
        ev AS (SELECT a.* FROM one a JOIN held b ON {on} AND a.rule_id = b.rule_id WHERE a.kind = 'required')"""


#: Characters that make places unreliable; the tables have no compatibility forms besides.
_HIDDEN = "[\\x{00AD}\\x{200B}\\x{2060}\\x{FEFF}\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{200C}\\x{200D}]"


def _split() -> str:
    left, right = (lambda p: f"regexp_matches(parts[i].text, '{p}')"), (lambda p: f"regexp_matches(parts[i + 1].text, '{p}')")
    word, opening, closing = "[\\p{L}\\p{N}]", "[(\\[{«''\"-]", "[,.;:!?\\])}»''\"-]"
    loose = f"({left('\\s$')} OR {right('^\\s')})"
    tight = f"({loose} OR {left(opening + '$')} OR {right('^' + closing)})"
    inside = f"(NOT {loose} AND {left(word + '$')} AND {right('^' + word)})"
    key = "conv_id, run, chunk, turn, source_type, size, path"
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    return f"""WITH r AS (SELECT * FROM {regions(_D)} q),
        w0 AS (SELECT *, list({{'turn': turn, 'text': text}}) OVER (PARTITION BY conv_id, run, chunk ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ps FROM r),
        w1 AS (SELECT conv_id, run, chunk, turn, source_type, n AS size, ps[1:n] AS parts FROM w0, (VALUES (2), (3), (4)) v(n) WHERE len(ps) >= n),
        w2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run, chunk ORDER BY turn, size) AS k FROM w1 WHERE list_sum(list_transform(parts, lambda p: length(p.text))) <= 4096),
        w3 AS (SELECT w2.*, path, CASE WHEN path = 1 THEN list_transform(parts, lambda p: p.text) ELSE list_transform(parts, lambda p: trim(p.text, ' ' || chr(9) || chr(10) || chr(13))) END AS texts,
            list_prepend('', list_transform(range(1, size), lambda i: CASE WHEN path = 2 THEN ' ' WHEN path = 3 OR {tight} THEN '' ELSE ' ' END)) AS glue
            FROM w2, (VALUES (1), (2), (3)) v(path) WHERE k <= 48 AND (path < 3 OR len(list_filter(range(1, size), lambda i: NOT {inside})) = 0)),
        w4 AS (SELECT *, array_to_string(list_transform(range(1, size + 1), lambda i: glue[i] || texts[i]), '') AS text FROM w3),
        w5 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run, chunk, turn, source_type, size, text ORDER BY path) AS nth FROM w4 WHERE text <> ''),
        w AS (SELECT {key}, text, texts, glue, parts FROM w5 WHERE nth = 1),
        fr AS (SELECT {key}, parts[i].turn AS frag, list_sum(list_transform(glue[1:i], lambda g: length(g))) + list_sum(list_transform(texts[1:i], lambda t: length(t))) AS hi, length(texts[i]) AS wide
            FROM w, (VALUES (1), (2), (3), (4)) v(i) WHERE i <= size),
        {_evidence('w', key)},
        top AS (SELECT {key}, action_group, arg_min(rule_id, ord) AS rule_id FROM ev WHERE is_primary GROUP BY {key}, action_group),
        sig AS (SELECT a.*, r0.n_required, r0.signal_id, r0.start, r0.stop FROM top a JOIN ev r0 ON {same.replace('b.', 'r0.')} AND r0.rule_id = a.rule_id),
        met AS (SELECT a.*, b.frag FROM sig a LEFT JOIN fr b ON {same} AND a.start < b.hi AND a.stop > b.hi - b.wide),
        per AS (SELECT {key}, action_group, rule_id, signal_id, count(DISTINCT frag) AS n FROM met GROUP BY ALL),
        alls AS (SELECT {key}, action_group, rule_id, count(DISTINCT frag) AS n_all FROM met GROUP BY ALL),
        map AS (SELECT a.*, b.least, b.most FROM alls a JOIN (SELECT {key}, rule_id, min(n) AS least, max(n) AS most FROM per GROUP BY {key}, rule_id) b ON {same} AND a.rule_id = b.rule_id),
        good AS (SELECT a.*, NOT regexp_matches(b.text, '{_HIDDEN}') AND least > 0 AND n_all <= 4 AS mapped FROM map a JOIN w b ON {same}),
        """


def _standalone() -> str:
    found = _evidence("r", "conv_id, run, chunk, turn")
    for name in ("tk", "pd", "hit", "nth", "spot", "one", "held", "ev"):
        found = found.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)").replace(f"JOIN {name} ", f"JOIN {name}2 ")
    return found.replace("pd.*", "pd2.*")


def _decided() -> str:
    """CTEs ending in ``e``: decisions of windows."""
    key = "conv_id, run, chunk, turn, source_type, size, path"
    return f"""{_split()} {_standalone()},
        own AS (SELECT DISTINCT conv_id, run, chunk, turn, action_group FROM ev2 WHERE is_primary),
        d AS (SELECT g.*, EXISTS (SELECT 1 FROM own o, w b WHERE {' AND '.join(f'g.{k} = b.{k}' for k in key.split(', '))} AND o.conv_id = g.conv_id AND o.run = g.run AND o.chunk = g.chunk
            AND o.action_group = g.action_group AND list_contains(list_transform(b.parts, lambda p: p.turn), o.turn)) AS standalone FROM good g),
        e AS (SELECT *, CASE WHEN mapped THEN n_all ELSE 0 END AS n_candidates, CASE WHEN NOT mapped OR standalone OR n_all < 2 THEN 0 WHEN source_type <> 'text' OR path = 3 THEN 1
            WHEN path = 1 AND n_all = size AND size <= 3 THEN 3 ELSE 2 END AS confidence FROM d)"""


def _p14() -> str:
    return f"""{_decided()} SELECT conv_id, turn, size, path, rule_id, mapped, n_candidates, mapped AND most > 1 AS split_signal, standalone, confidence, source_type = 'text' AND confidence >= 2 AS eligible FROM e"""


def _contexts() -> str:
    def some(name: str, every: bool = False) -> str:
        test = CONTEXT_SEEDS[name].replace("conv_id", "e.conv_id").replace("turn", "p.turn")
        return f"len(list_filter(w.parts, lambda p: {test})) {'= len(w.parts)' if every else '> 0'}"

    flags = ", ".join(f"{some(c)} AS any_{c}" for c in CONTEXT_SEEDS)
    # what a fragment that stands so caps
    capped = "CASE WHEN confidence = 0 OR any_code OR any_quote THEN 0 WHEN any_navigation OR any_in_list THEN least(confidence, 1) WHEN any_partial THEN least(confidence, 2) ELSE confidence END"
    return f"""{_decided()}, x AS (SELECT e.*, {flags}, {some('in_list', True)} AS all_in_list FROM e JOIN w USING (conv_id, run, chunk, turn, source_type, size, path)),
        y AS (SELECT *, {capped} AS capped FROM x)
        SELECT conv_id, turn, size, path, rule_id, any_code, any_in_list, all_in_list, capped AS confidence, source_type = 'text' AND path < 3 AND capped >= 2 AS usual, source_type = 'text' AND path < 3 AND capped >= 3 AS strict, capped >= 1 AS lenient FROM y"""


def _p19() -> str:
    """Windows are stretches of a region, so those that meet are islands: a new one begins beyond all that came before."""
    group = "conv_id, run, chunk, source_type, action_group"
    better = "confidence * 100 + CASE WHEN rule_id LIKE 'sensitive-disclosure.%' AND transfer THEN 30 ELSE 20 END + CASE path WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END"
    return f"""{_decided()},
        k AS (SELECT e.*, w.parts, list_max(list_transform(w.parts, lambda p: p.turn)) AS last_turn, EXISTS (SELECT 1 FROM one o WHERE o.conv_id = e.conv_id AND o.run = e.run AND o.chunk = e.chunk AND o.turn = e.turn
            AND o.source_type = e.source_type AND o.size = e.size AND o.path = e.path AND o.rule_id = e.rule_id AND o.signal_id = 'external-transfer') AS transfer
            FROM e JOIN w USING (conv_id, run, chunk, turn, source_type, size, path) WHERE e.source_type = 'text' AND e.confidence >= 2),
        m AS (SELECT *, CASE WHEN turn > max(last_turn) OVER (PARTITION BY {group} ORDER BY turn, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM k),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY {group} ORDER BY turn, size, path) AS island FROM m),
        o2 AS (SELECT *, row_number() OVER (PARTITION BY {group}, island ORDER BY {better} DESC, turn, size, path) AS best FROM n),
        c2 AS (SELECT {group}, island, array_to_string(list_sort(list_distinct(flatten(list(list_transform(parts, lambda p: p.turn))))), ',') AS candidates, count(*) AS n_decisions FROM o2 GROUP BY {group}, island)
        SELECT {group}, rule_id, confidence, CASE WHEN rule_id LIKE 'sensitive-disclosure.%' AND transfer THEN 3 ELSE 2 END AS severity, path, candidates, n_decisions FROM o2 JOIN c2 USING ({group}, island) WHERE best = 1"""


def _literals() -> str:
    """CTEs ending in ``lh``: literals between borders in segments, numbered in the order of the catalogue."""
    edge = "[^\\p{L}\\p{M}\\p{N}\\p{Pc}]"
    norm = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
    words = lambda e: f"array_to_string(regexp_extract_all({e}, '{TOKEN}'), ' ')"
    seeds = values("nr, literal_id, source, enabled, mode", [(k, *x) for k, x in enumerate(LITERAL_SEEDS)], _D)
    return f"""items AS (SELECT nr, literal_id, source FROM {seeds} z WHERE enabled AND mode = 'literal'
            UNION ALL SELECT 1000 + row_number() OVER (ORDER BY item_id), 'b' || item_id, array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark WHERE text IS NOT NULL),
        nm AS (SELECT *, {norm.format('source')} AS whole, regexp_matches({norm.format('source')}, '[*+?()\\[\\]{{}}|\\\\^$/]') AS exact FROM items),
        tx AS (SELECT nr, literal_id, exact, whole, CASE WHEN exact THEN whole ELSE {words('whole')} END AS lit FROM nm),
        lits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exact, lit ORDER BY nr) AS copy FROM tx WHERE lit <> '') WHERE copy = 1 ORDER BY nr LIMIT 500),
        body AS (SELECT g.doc_id, g.segment, q.in_code OR q.in_quote AS mitigated, substring(g.text, g.start + 1, g.stop - g.start) AS text FROM seg g JOIN {seeded_docs(_D)} q ON g.doc_id = q.doc_id),
        both_forms AS (SELECT *, {norm.format('text')} AS whole, {words(norm.format('text'))} AS said FROM body),
        lh AS (SELECT b.doc_id, b.segment, b.mitigated, l.literal_id, l.lit, l.whole AS own, row_number() OVER (PARTITION BY b.doc_id, b.segment ORDER BY l.nr) AS place FROM both_forms b JOIN lits l
            ON contains(CASE WHEN l.exact THEN b.whole ELSE b.said END, l.lit) AND regexp_matches(CASE WHEN l.exact THEN b.whole ELSE b.said END, '(^|{edge})' || regexp_escape(l.lit) || '({edge}|$)'))"""


def _folded() -> str:
    related = f"""hold AS (SELECT DISTINCT l.literal_id, a.rule_id, a.action_group, a.n_required, a.signal_id FROM lits l JOIN {_alternatives()} a
            ON a.is_primary AND a.kind = 'required' AND contains(' ' || array_to_string(regexp_extract_all(l.whole, '{TOKEN}'), ' ') || ' ', ' ' || a.phrase || ' ')),
        rel AS (SELECT literal_id, min(action_group) AS related FROM (SELECT literal_id, action_group FROM hold GROUP BY literal_id, rule_id, action_group, n_required HAVING count(*) = n_required) GROUP BY literal_id HAVING count(DISTINCT action_group) = 1)"""
    return f"""WITH RECURSIVE {_segments()}, {_literals()}, {related}, {_evidence('body', 'doc_id, segment')},
        inner_groups AS (SELECT doc_id, segment, action_group, arg_min(rule_id, ord) AS rule_id FROM ev WHERE is_primary GROUP BY ALL),
        own AS (SELECT l.doc_id, l.segment, coalesce(i.action_group, 'custom-pattern:' || l.literal_id) AS action_group, l.literal_id,
            CASE WHEN i.action_group IS NULL THEN CASE WHEN length(l.lit) <= 2 OR l.mitigated THEN 'low' ELSE 'medium' END END AS severity
            FROM lh l LEFT JOIN rel r ON r.literal_id = l.literal_id LEFT JOIN inner_groups i ON i.doc_id = l.doc_id AND i.segment = l.segment AND i.action_group = r.related),
        every AS (SELECT doc_id, segment, action_group, CAST(NULL AS VARCHAR) AS rule_id, literal_id, severity FROM own UNION ALL SELECT doc_id, segment, action_group, rule_id, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM inner_groups)
        SELECT doc_id, segment, action_group, coalesce(max(rule_id), action_group) AS rule_id, {_D.joined('literal_id')} AS literals, max(severity) AS severity FROM every GROUP BY doc_id, segment, action_group"""


def _limited(rows: str) -> str:
    """CTEs ending in ``walk``: calls of each sender one after the other, with the accepted ones of the last ten seconds."""
    recent = "list_filter(w.times, lambda t: t > p.now_ms - 10000)"
    return f"""asked AS (SELECT seq, sender, now_ms, row_number() OVER (PARTITION BY sender ORDER BY now_ms, seq) AS k FROM {rows} r),
        walk AS (SELECT seq, sender, now_ms, k, true AS allowed, [now_ms] AS times FROM asked WHERE k = 1 UNION ALL
            SELECT p.seq, p.sender, p.now_ms, p.k, len({recent}) < 20, CASE WHEN len({recent}) < 20 THEN list_append({recent}, p.now_ms) ELSE {recent} END FROM walk w JOIN asked p ON p.sender = w.sender AND p.k = w.k + 1)"""


def _gates() -> str:
    first = "CASE WHEN NOT sender IN (0, 1, 2, 3, 4, 5) THEN 'allowlist' WHEN from_page THEN 'page' WHEN action NOT IN ('hello', 'get-findings') THEN 'action' END"
    return f"""WITH RECURSIVE calls AS (SELECT *, {first} AS gate FROM {seeded_calls(_D)} c), counted AS (SELECT * FROM calls WHERE gate IS NULL), {_limited('counted')}
        SELECT c.seq, c.sender, c.action, coalesce(c.gate, CASE WHEN NOT w.allowed THEN 'rate' WHEN c.action = 'hello' THEN 'ok' WHEN NOT c.in_front THEN 'front' WHEN c.tab_id <> 1 THEN 'tab' ELSE 'ok' END) AS gate
        FROM calls c LEFT JOIN walk w ON c.seq = w.seq"""


def _captures() -> str:
    """Every point held against every box of its page."""
    up = "floor({} + 0.5)"
    ix, iy = (f"greatest(4, {up.format(f'({a}) * 0.25')})" for a in ("r - l", "b - t"))
    points = [("l + (r - l) / 2", "t + (b - t) / 2"), (f"l + {ix}", f"t + {iy}"), (f"r - {ix}", f"t + {iy}"), (f"l + {ix}", f"b - {iy}"), (f"r - {ix}", f"b - {iy}")]
    listed = ", ".join(f"({k}, least(greatest({up.format(x)}, 0), 1279), least(greatest({up.format(y)}, 0), 719))" for k, (x, y) in enumerate(points))
    return f"""WITH e AS (SELECT *, node_id % 2 = 0 OR is_input AS is_target, greatest(0, x) AS l, greatest(0, y) AS t, least(1280, x + width) AS r, least(720, y + height) AS b FROM {seeded_elements(_D)} q),
        v AS (SELECT * FROM e WHERE r > l AND b > t AND pointer),
        ly AS (SELECT * FROM v WHERE position IN ('fixed', 'absolute', 'sticky') AND (z >= 1 OR opacity <= 0.35 OR position = 'fixed') AND r - l >= 32 AND b - t >= 24),
        pt AS (SELECT ly.page_id, ly.node_id AS layer_id, ly.z AS layer_z, ly.opacity <= 0.35 AS weak, nr, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py FROM ly, LATERAL (SELECT * FROM (VALUES {listed}) p(nr, px, py))),
        st AS (SELECT pt.*, v.node_id, v.is_target, v.is_input, row_number() OVER (PARTITION BY pt.page_id, layer_id, nr ORDER BY v.z DESC, v.node_id DESC) AS depth
            FROM pt JOIN v ON pt.page_id = v.page_id AND v.l <= px AND px < v.r AND v.t <= py AND py < v.b),
        un AS (SELECT page_id, layer_id, layer_z, weak, nr, px, py, arg_min(node_id, depth) FILTER (is_target AND node_id <> layer_id) AS target_id, arg_min(is_input, depth) FILTER (is_target AND node_id <> layer_id) AS critical
            FROM st GROUP BY ALL HAVING bool_or(depth = 1 AND node_id = layer_id)),
        f AS (SELECT *, row_number() OVER (PARTITION BY page_id, layer_id ORDER BY nr) AS k FROM un WHERE target_id IS NOT NULL)
        SELECT page_id, layer_id, target_id, px, py, CASE WHEN critical AND (layer_z >= 20 OR weak) THEN 'high' ELSE 'medium' END AS severity FROM f WHERE k = 1"""


ORACLES = {
    "t08_segments": f"WITH RECURSIVE {_segments()} SELECT doc_id, segment, start, stop FROM seg",
    "t08_segment_findings": f"""WITH RECURSIVE {_segments()}, src AS (SELECT doc_id, segment, start AS origin, substring(text, start + 1, stop - start) AS text FROM seg), {_evidence('src', 'doc_id, segment, origin')}
        SELECT doc_id, rule_id, count(DISTINCT segment) AS n_segments, count(DISTINCT signal_id || ':' || (start + origin)) AS n_places, CAST(min(start + origin) AS BIGINT) AS first FROM ev GROUP BY doc_id, rule_id""",
    "s24_signal_places": f"""WITH src AS (SELECT doc_id, text FROM {seeded_docs(_D)} q), {_evidence('src', 'doc_id')}
        SELECT e.doc_id, e.rule_id, e.signal_id, CAST(e.start AS BIGINT) AS start, CAST(e.stop AS BIGINT) AS stop, length(s.text) <= 4096 AND NOT regexp_matches(s.text, '{_HIDDEN}') AS reliable FROM ev e JOIN src s ON e.doc_id = s.doc_id""",
    "g09_serving_gates": _gates(),
    "g10_rate_limit": f"WITH RECURSIVE requests AS (SELECT seq, request_id AS sender, now_ms FROM {seeded_requests(_D)} q WHERE request_id IS NOT NULL AND now_ms IS NOT NULL), {_limited('requests')} SELECT seq, sender, now_ms, allowed FROM walk",
    "v25_click_captures": _captures(),
    "p14_contributions": _p14(),
    "p16_context_decisions": _contexts(),
    "p19_merged_decisions": _p19(),
    "s09_literals": f"WITH RECURSIVE {_segments()}, {_literals()} SELECT doc_id, segment, literal_id, place FROM lh",
    "s22_literal_cap_kept": f"WITH RECURSIVE {_segments()}, {_literals()} SELECT doc_id, segment, least(count(*), 2) AS kept, count(*) > 2 AS partial FROM lh GROUP BY doc_id, segment",
    "s19_literal_groups": _folded(),
}
