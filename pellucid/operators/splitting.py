"""Instructions split over neighbouring fragments (P): conversations are regions, turns candidates."""

from __future__ import annotations

from pellucid.functions.catalog import RULES, tokens
from pellucid.functions.dialect import Spark, values
from pellucid.operators.semantic import TOKEN
from pellucid.sources.seeds import seeded_turns

LONGEST_WINDOW, WINDOWS_PER_REGION, REGION_CANDIDATES = 4_096, 48, 32


def regions(d: Spark) -> str:
    """Turns in order with the run of equal role they belong to, cut after 32 candidates."""
    marks = f"""(SELECT t.*, CASE WHEN lag(source_type) OVER (PARTITION BY conv_id ORDER BY turn) = source_type THEN 0 ELSE 1 END AS fresh FROM {seeded_turns(d)} t)"""
    runs = f"(SELECT m.*, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {marks} m)"
    placed = f"(SELECT r.*, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS place FROM {runs} r)"
    return f"(SELECT conv_id, turn, text, source_type, CAST(run AS BIGINT) AS run, CAST({d.div('place', str(REGION_CANDIDATES))} AS BIGINT) AS chunk, place FROM {placed} p)"


def _lead(k: int) -> str:
    over = "OVER (PARTITION BY conv_id, run, chunk ORDER BY turn)"
    return f"lead(text, {k}) {over} AS t{k}, lead(turn, {k}) {over} AS turn{k}"


def windows(d: Spark) -> str:
    """Two to four consecutive fragments of one source in one region."""
    base = f"(SELECT conv_id, run, chunk, turn, source_type, text AS t0, {_lead(1)}, {_lead(2)}, {_lead(3)} FROM {regions(d)} r)"
    sizes = d.unnest(base, d.array("2", "3", "4"), "CASE val WHEN 2 THEN t1 WHEN 3 THEN t2 ELSE t3 END IS NOT NULL")
    sized = f"""(SELECT conv_id, run, chunk, turn, source_type, val AS size, CASE val WHEN 2 THEN turn1 WHEN 3 THEN turn2 ELSE turn3 END AS last_turn, t0, t1,
        CASE WHEN val > 2 THEN t2 END AS t2, CASE WHEN val > 3 THEN t3 END AS t3 FROM {sizes} z)"""
    total = "length(t0) + length(t1) + coalesce(length(t2), 0) + coalesce(length(t3), 0)"
    ranked = f"(SELECT w.*, row_number() OVER (PARTITION BY conv_id, run, chunk ORDER BY turn, size) AS k FROM {sized} w WHERE {total} <= {LONGEST_WINDOW})"
    return f"(SELECT * FROM {ranked} r WHERE k <= {WINDOWS_PER_REGION})"


def _separator(d: Spark, left: str, right: str) -> str:
    """Nothing at white space, behind an opener or before a closer; otherwise one space (P10)."""
    tight = f"{d.matches(left, r'[\s(\[{«“-]$')} OR {d.matches(right, r'^[\s)\]}»”.,;:!?]')}"
    return f"CASE WHEN {tight} THEN '' ELSE ' ' END"


def variants(d: Spark) -> str:
    """Assembled texts of each window, equal ones under the first path."""
    rest = "".join(f" || coalesce(({_separator(d, f't{k - 1}', f't{k}')}) || t{k}, '')" for k in (1, 2, 3))
    spaced = "trim(t0)" + "".join(f" || coalesce(' ' || trim(t{k}), '')" for k in (1, 2, 3))
    compact = "trim(t0)" + "".join(f" || coalesce(trim(t{k}), '')" for k in (1, 2, 3))
    word = f"{d.matches('t0', r'[\p{L}\p{N}]$')} AND {d.matches('t1', r'^[\p{L}\p{N}]')}"
    paths = d.unnest(windows(d), d.array("1", "2", "3"), f"val < 3 OR ({word})")
    every = f"""(SELECT conv_id, turn, source_type, size, last_turn, val AS path, CASE val WHEN 1 THEN t0{rest} WHEN 2 THEN {spaced} ELSE {compact} END AS text FROM {paths} a)"""
    return f"(SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY conv_id, turn, size, text ORDER BY path) AS rn FROM {every} e) x WHERE rn = 1)"


def _phrases(d: Spark) -> str:
    rows = [(r.rule_id, r.action_group, len(r.of("required")), kind, s, tokens(p)) for r in RULES if r.primary for kind in ("required", "forbidden") for s, ps in r.of(kind) for p in ps]
    return values("rule_id, action_group, n_required, kind, signal_id, phrase", list(dict.fromkeys(rows)), d)


def _matches(d: Spark, table: str, key: str) -> str:
    """Primary rules that hold in a table's ``text``, by its key columns."""
    padded = f"(SELECT t.*, ' ' || {d.join_array(d.extract_all('lower(text)', TOKEN, 0))} || ' ' AS padded FROM {table} t)"
    met = f"{padded} t JOIN {_phrases(d)} p ON contains(t.padded, ' ' || p.phrase || ' ')"
    if d.name == "spark":  # only texts that have a phrase's first word are searched for it
        firsts = sorted({tokens(p).split(" ")[0] for r in RULES if r.primary for kind in ("required", "forbidden") for _, ps in r.of(kind) for p in ps})
        # never null: a test for nulls that the join asks for would make a text and find its words once more
        words = f"(SELECT {key}, padded, explode(array_intersect(split(padded, ' '), array({', '.join(map(d.text, firsts))}))) AS first FROM (SELECT {key}, coalesce(padded, '') AS padded FROM {padded} u) t)"
        met = f"{words} w JOIN (SELECT p.*, split_part(phrase, ' ', 1) AS begins FROM {_phrases(d)} p) p ON w.first = p.begins AND contains(w.padded, ' ' || p.phrase || ' ')"
    hits = f"""(SELECT {key}, rule_id, action_group, n_required, count(DISTINCT CASE WHEN kind = 'required' THEN signal_id END) AS n_hit, sum(CASE WHEN kind = 'forbidden' THEN 1 ELSE 0 END) AS n_bad
        FROM {met} GROUP BY {key}, rule_id, action_group, n_required)"""
    return f"(SELECT {key}, rule_id, action_group FROM {hits} h WHERE n_hit = n_required AND n_bad = 0)"


WINDOW_KEY = "conv_id, turn, size, path, source_type, last_turn"


def decisions(d: Spark) -> str:
    """Rules that windows satisfy, with their confidence and whether a fragment alone does too."""
    alone = _matches(d, f"(SELECT conv_id, turn, text FROM {regions(d)} r)", "conv_id, turn")
    whole = _matches(d, variants(d), WINDOW_KEY)
    told = f"""(SELECT w.conv_id, w.turn, w.size, w.path, w.source_type, w.last_turn, w.rule_id, w.action_group, max(CASE WHEN a.turn IS NULL THEN 0 ELSE 1 END) AS standalone
        FROM {whole} w LEFT JOIN {alone} a ON a.conv_id = w.conv_id AND a.action_group = w.action_group AND a.turn BETWEEN w.turn AND w.last_turn
        GROUP BY w.conv_id, w.turn, w.size, w.path, w.source_type, w.last_turn, w.rule_id, w.action_group)"""
    return f"""(SELECT t.*, CASE WHEN standalone = 1 THEN 0 WHEN path = 3 OR source_type = 'title' THEN 1 WHEN path = 1 AND size <= 3 THEN 3 ELSE 2 END AS rank FROM {told} t)"""


def _merged(d: Spark) -> str:
    """The best decision for each action group of a region, the shortest and earliest among equals."""
    order = "PARTITION BY conv_id, action_group ORDER BY rank DESC, size, path, turn, rule_id"
    return f"(SELECT * FROM (SELECT x.*, row_number() OVER ({order}) AS rn, count(*) OVER (PARTITION BY conv_id, action_group) AS n FROM {decisions(d)} x WHERE rank > 0) y WHERE rn = 1)"


QUERIES = {
    "p06_regions": lambda d: f"SELECT conv_id, turn, run, chunk FROM {regions(d)} r",
    "p07_budgets": lambda d: f"SELECT conv_id, count(*) <= 2000 AND sum(length(text)) <= 250000 AS complete, CAST(count(*) AS BIGINT) AS n FROM {regions(d)} r GROUP BY conv_id",
    "p08_windows": lambda d: f"SELECT conv_id, turn, size, last_turn FROM {windows(d)} w",
    "p09_variants": lambda d: f"SELECT conv_id, turn, size, path, length(text) AS chars FROM {variants(d)} v",
    "p10_separator": lambda d: f"SELECT conv_id, turn, {_separator(d, 't0', 't1')} = '' AS tight FROM {windows(d)} w WHERE size = 2",
    "p11_spans": lambda d: f"SELECT conv_id, turn, size, length(t0) AS end0, length(t0) + length({_separator(d, 't0', 't1')}) AS start1, length(t0) + length({_separator(d, 't0', 't1')}) + length(t1) AS end1 FROM {windows(d)} w",
    "speakers": lambda d: f"SELECT conv_id, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1 AS any_user, min(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1 AS all_user FROM {seeded_turns(d)} t GROUP BY conv_id",
    "p13_variant_dedupe": lambda d: f"SELECT path, CAST(count(*) AS BIGINT) AS n FROM {variants(d)} v GROUP BY path",
    "split_decisions": lambda d: f"SELECT conv_id, turn, size, path, rule_id, last_turn FROM {decisions(d)} x",
    "p15_standalone": lambda d: f"SELECT conv_id, turn, size, path, rule_id, standalone FROM {decisions(d)} x",
    "p16_confidence": lambda d: f"SELECT conv_id, turn, size, path, rule_id, rank FROM {decisions(d)} x",
    "p17_eligible": lambda d: f"SELECT conv_id, turn, size, path, rule_id FROM {decisions(d)} x WHERE rank >= 2 AND standalone = 0",
    "p18_policies": lambda d: f"SELECT conv_id, action_group, rank >= 2 AS under_moderate, rank >= 3 AS under_strong FROM {_merged(d)} m",
    "p19_merged": lambda d: f"SELECT conv_id, action_group, rule_id, rank, turn, size, CAST(n AS BIGINT) AS n FROM {_merged(d)} m",
    "p21_signature": lambda d: f"SELECT conv_id, {d.joined('concat(action_group, chr(58), CAST(rank AS VARCHAR(9)))')} AS signature FROM {_merged(d)} m GROUP BY conv_id",
    "p23_snapshot": lambda d: f"SELECT conv_id, action_group, rn2 FROM (SELECT m.conv_id, m.action_group, row_number() OVER (PARTITION BY conv_id ORDER BY turn, action_group) AS rn2 FROM {_merged(d)} m) x WHERE rn2 <= 10",
}
