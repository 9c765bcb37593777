"""Page roll-ups, published views, remediation plans and network rules (G, R, N, C)."""

from __future__ import annotations

from pellucid.functions.dialect import Spark, values
from pellucid.operators import links, semantic, splitting, visual
from pellucid.sources.seeds import seeded_snapshots

PUBLISHED, QUEUED, CLIPS = 10, 50, (96, 300, 600)
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_SEVERITY = "CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"

# Finding types that may be marked in a page, by how, and keys whose values are redacted.
ANNOTATABLE = ("display-none", "visibility-hidden", "opacity-zero", "link-mismatch", "trigger")
SIBLING_ONLY = ("full-screen-overlay", "redirect")
SENSITIVE_KEYS = ("password", "token", "key", "secret", "auth", "custompatterns")
NETWORK_RULES = [
    (1, 1, "block", "://([^/?#]*[.])?malicious-domain[.]com([/?#:]|$)"), (2, 1, "block", "://([^/?#]*[.])?phishing-site[.]com([/?#:]|$)"),
    (3, 2, "block", "^https?://[^/]+/malicious-script[.]js$"), (4, 2, "block", "^https?://[^/]+/tracker[.]js$"),
    (5, 3, "redirect", "://([^/?#]*[.])?ad-server[.]com([/?#:]|$)"), (6, 1, "modifyHeaders", ""),
    (7, 2, "modifyHeaders", "^https?://your-site[.]com$"), (8, 1, "block", "(password|token|key|secret)=[^&]*"),
    (9, 2, "block", "data:text/html,.*javascript:"), (10, 1, "allow", "://([^/?#]*[.])?google[.]com([/?#:]|$)"),
]
# End of the fixed values.


def findings(d: Spark) -> str:
    """Every module's findings in one schema; no text of a page is among the columns."""
    return f"""(SELECT page_id, 1 AS module_ord, 'visual' AS module, type, rank, CAST(1 AS BIGINT) AS n, dedupe_key FROM {visual.findings(d)} v
        UNION ALL SELECT page_id, 2, 'links', type, {_RANK}, CAST(1 AS BIGINT), dedupe_key FROM {links.findings(d)} l WHERE rn = 1
        UNION ALL SELECT page_id, 3, 'trigger', 'trigger', rank, occurrence_count, concat(source_type, '|', action_group) FROM {semantic.findings(d)} s
        UNION ALL SELECT {d.div('conv_id', '40')}, 4, 'splitting', 'split-prompt', rank, CAST(1 AS BIGINT), concat(CAST(conv_id AS VARCHAR(20)), '|', action_group) FROM {splitting._merged(d)} p)"""


def pages(d: Spark) -> str:
    """Counts by module and in total for each page, those without findings too."""
    modules = ("visual", "links", "trigger", "splitting")
    counts = ", ".join(f"sum(CASE WHEN module = '{m}' THEN 1 ELSE 0 END) AS {m}" for m in modules)
    found = f"(SELECT page_id, {counts}, count(*) AS total, max(rank) AS worst FROM {findings(d)} f GROUP BY page_id)"
    filled = ", ".join(f"CAST(coalesce(c.{m}, 0) AS BIGINT) AS {m}" for m in (*modules, "total"))
    every = "(SELECT DISTINCT page_id FROM pages WHERE page_id IS NOT NULL)"
    return f"(SELECT coalesce(e.page_id, c.page_id) AS page_id, {filled}, coalesce(c.worst, 0) AS worst FROM {every} e FULL JOIN {found} c ON e.page_id = c.page_id)"


def _flat(d: Spark) -> str:
    ranked = f"(SELECT f.*, row_number() OVER (PARTITION BY page_id, module ORDER BY rank DESC, type, dedupe_key) AS rn FROM {findings(d)} f)"
    return f"SELECT page_id, module_ord, module, substr(type, 1, 96) AS type, {_SEVERITY} AS severity, rn FROM {ranked} r WHERE rn <= {PUBLISHED}"


def _published(d: Spark) -> str:
    """At most ten findings of each module and page, their fields clipped to 96, 300 and 600 characters; more are counted."""
    over = "PARTITION BY page_id, module"
    ranked = f"(SELECT f.*, row_number() OVER ({over} ORDER BY rank DESC, type, dedupe_key) AS rn, count(*) OVER ({over}) AS n_all FROM {findings(d)} f)"
    return f"""SELECT page_id, module, rn, substr(type, 1, {CLIPS[0]}) AS type, {_SEVERITY} AS severity, substr(concat(module, ': ', type), 1, {CLIPS[1]}) AS summary, substr(dedupe_key, 1, {CLIPS[2]}) AS details,
        CAST(greatest(n_all - {PUBLISHED}, 0) AS BIGINT) AS omitted FROM {ranked} r WHERE rn <= {PUBLISHED}"""


def _queued(d: Spark) -> str:
    """Findings that a page's remediation takes, in the order of modules and keys: no more than fifty."""
    plan = f"CASE WHEN type IN ({', '.join(repr(t) for t in ANNOTATABLE)}) THEN 'annotate' WHEN type IN ({', '.join(repr(t) for t in SIBLING_ONLY)}) THEN 'sibling' END"
    planned = f"(SELECT page_id, module_ord, type, dedupe_key, {plan} AS plan FROM {findings(d)} f)"
    return f"SELECT page_id, type, dedupe_key, plan, rn FROM (SELECT p.*, row_number() OVER (PARTITION BY page_id ORDER BY module_ord, dedupe_key, type) AS rn FROM {planned} p WHERE plan IS NOT NULL) q WHERE rn <= {QUEUED}"


def _redacted(d: Spark) -> str:
    e = "concat('page=', CAST(page_id AS VARCHAR(20)), '&token=', substr(md5(url), 1, 6), ' auth=', CAST(page_id % 7 AS VARCHAR(9)), ' name=x')"
    for key in SENSITIVE_KEYS:
        e = d.replace(e, f"({key}=)([^&\\s]+)", r"$1***REDACTED***" if d.name == "spark" else r"\1***REDACTED***")
    return f"SELECT page_id, {e} AS line FROM pages WHERE url IS NOT NULL"


def _network(d: Spark) -> str:
    """The rule of the highest priority that a target meets; of equals, allow and then the least id."""
    rules = values("id, priority, action, pattern", NETWORK_RULES, d)
    like = "regexp_like" if d.name == "spark" else "regexp_matches"
    hits = f"(SELECT t.page_id, t.ord, r.id, r.action, row_number() OVER (PARTITION BY t.page_id, t.ord ORDER BY r.priority DESC, CASE r.action WHEN 'allow' THEN 0 WHEN 'block' THEN 1 WHEN 'redirect' THEN 2 ELSE 3 END, r.id) AS k FROM {links.targets(d)} t JOIN {rules} r ON {like}(t.href, r.pattern))"
    return f"SELECT page_id, ord, id AS rule_id, action FROM {hits} h WHERE k = 1"


def _frames(d: Spark) -> str:
    """What pages total if a frame's report replaces its last one, and if reports add up; late ones replace nothing."""
    own = "PARTITION BY page_id, frame_id"
    told = f"""(SELECT s.*, row_number() OVER ({own} ORDER BY now_ms DESC, seq DESC) AS newest,
        now_ms < max(now_ms) OVER ({own} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM {seeded_snapshots(d)} s)"""
    latest = lambda e: f"sum(CASE WHEN newest = 1 THEN {e} ELSE 0 END)"
    return f"""SELECT page_id, CAST({latest('1')} AS BIGINT) AS n_frames, CAST({latest('n')} AS BIGINT) AS replaced, CAST(sum(n) AS BIGINT) AS accumulated, CAST(sum(CASE WHEN late THEN 1 ELSE 0 END) AS BIGINT) AS late,
        {latest('CASE WHEN partial THEN 1 ELSE 0 END')} > 0 AS partial, CASE WHEN {latest('n')} > 0 THEN 'issues' ELSE 'clean' END AS status FROM {told} t GROUP BY page_id"""


QUERIES = {
    "g03_frame_snapshots": _frames,
    "g01_module_counts": lambda d: f"SELECT module, CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS occurrences FROM {findings(d)} f GROUP BY module",
    "g02_page_rollup": lambda d: f"SELECT p.*, CASE WHEN total > 0 THEN 'issues' ELSE 'clean' END AS status FROM {pages(d)} p",
    "g04_partial_modules": lambda d: f"SELECT page_id, {d.joined('module')} AS modules FROM {findings(d)} f GROUP BY page_id",
    "g05_clipped": lambda d: f"SELECT page_id, module, substr(type, 1, 96) AS clipped_type, rank FROM {findings(d)} f",
    "g06_page_identity": lambda d: f"SELECT page_id, substr({d.extract('url', '^(https?://[^/?#]+[^?#]*)')}, 1, 2048) AS identity FROM pages",
    "g07_badge": lambda d: f"SELECT page_id, CASE WHEN total = 0 THEN '' WHEN total > 99 THEN '99+' ELSE CAST(total AS VARCHAR(9)) END AS badge FROM {pages(d)} p",
    "g08_flat_list": _flat,
    "g11_context_block": lambda d: f"SELECT page_id, least(total, 100) AS total, least(greatest(links, 0), 100) AS links FROM {pages(d)} p",
    "g12_scannable": lambda d: f"SELECT page_id, {d.matches('url', '^https?://')} AS scannable FROM pages",
    "nodes_with_text": lambda d: f"SELECT v.page_id, v.node_id, v.type FROM {visual.findings(d)} v WHERE EXISTS (SELECT 1 FROM {visual.elements(d)} e WHERE e.page_id = v.page_id AND e.node_id = v.node_id AND e.chars > 5)",
    "r01_queued": _queued,
    "g05_published_items": _published,
    "r01_remediation_plan": lambda d: f"""SELECT page_id, type, CASE WHEN type IN ({', '.join(repr(t) for t in ANNOTATABLE)}) THEN 'annotate' WHEN type IN ({', '.join(repr(t) for t in SIBLING_ONLY)}) THEN 'sibling' ELSE 'ignore' END AS plan, CAST(count(*) AS BIGINT) AS n
        FROM {findings(d)} f GROUP BY page_id, type""",
    "n01_network_rules": _network,
    "c04_redaction": _redacted,
}
