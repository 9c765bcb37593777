"""Rule matching and assessment of texts (S), and what is made of assessments (T).

A phrase matches where its words follow each other: texts and phrases are joined word by word with one
space between and around, so that containment is alignment. A text is searched for those phrases alone whose
first word it has; the rules are a constant of the plan and texts are never shuffled for it.
"""

from __future__ import annotations

from pellucid.functions.catalog import IMPACT, RULES, SEVERITY, phrase_rows
from pellucid.functions.dialect import Spark, values
from pellucid.sources.seeds import seeded_docs

TOKEN = r"[\p{L}\p{M}\p{N}]+"
MATCH_CAP, SNAPSHOT_CAP, CANDIDATE_BUDGET, CHAR_BUDGET, EVALUATION_BUDGET = 10, 10, 3_000, 500_000, 30_000
#: Texts that a scan takes for one page.
SCANNED_TOGETHER = 250
LONGEST_CANDIDATE = 4_096

#: Literals that a user has added: id, text, the number of its visible characters.
CUSTOM = [("c1", "system prompt"), ("c2", "the"), ("c3", "previous instructions"), ("c4", "ab"), ("c5", "идти")]
#: The action group that a literal belongs to if its text satisfies a primary rule.
SENSITIVITY = {"low": ("high",), "medium": ("medium", "high"), "high": ("low", "medium", "high")}


def texts(d: Spark) -> str:
    """Seeded documents with ``padded``, their words."""
    return f"""(SELECT x.*, ' ' || {d.join_array(d.extract_all('lower(x.text)', TOKEN, 0))} || ' ' AS padded FROM {seeded_docs(d)} x)"""


def phrases(d: Spark) -> str:
    return values("ord, rule_id, category, action_group, is_primary, kind, signal_id, phrase", phrase_rows(), d)


def rules(d: Spark) -> str:
    rows = [(k, r.rule_id, r.category, r.action_group, r.primary, r.language, len(r.of("required")), len(r.of("optional")), len(r.of("forbidden"))) for k, r in enumerate(RULES)]
    return values("ord, rule_id, category, action_group, is_primary, language, n_required, n_optional, n_forbidden", rows, d)


def phrase_hits(d: Spark) -> str:
    """Texts with the phrases in them. Spark finds them by first words; the checking form holds every phrase against every text."""
    found = f"(SELECT t.doc_id, t.padded, p.* FROM {texts(d)} t JOIN {phrases(d)} p ON contains(t.padded, ' ' || p.phrase || ' '))"
    if d.name != "spark":
        return found
    distinct = sorted({(row[-1].split(" ")[0], row[-1]) for row in phrase_rows()})
    first = ", ".join(d.text(w) for w in sorted({w for w, _ in distinct}))
    # never null: a test for nulls that the join asks for would find a text's words once more
    words = f"(SELECT t.doc_id, t.padded, explode(array_intersect(split(t.padded, ' '), array({first}))) AS first FROM (SELECT doc_id, coalesce(padded, '') AS padded FROM {texts(d)} u) t)"
    named = f"(SELECT w.doc_id, w.padded, q.phrase FROM {words} w JOIN {values('first, phrase', distinct, d)} q ON w.first = q.first AND contains(w.padded, ' ' || q.phrase || ' '))"
    return f"(SELECT n.doc_id, n.padded, p.* FROM {named} n JOIN {phrases(d)} p ON n.phrase = p.phrase)"


def matches(d: Spark) -> str:
    """One row per text and rule that holds: all required signals, no forbidden one."""
    hits = f"(SELECT doc_id, rule_id, kind, signal_id FROM {phrase_hits(d)} p GROUP BY doc_id, rule_id, kind, signal_id)"
    per_rule = f"""(SELECT doc_id, rule_id, sum(CASE WHEN kind = 'required' THEN 1 ELSE 0 END) AS n_hit, sum(CASE WHEN kind = 'forbidden' THEN 1 ELSE 0 END) AS n_bad,
        {d.joined("CASE WHEN kind = 'optional' THEN signal_id END")} AS supporting FROM {hits} h GROUP BY doc_id, rule_id)"""
    return f"""(SELECT m.doc_id, r.ord, r.rule_id, r.category, r.action_group, r.is_primary, m.supporting, row_number() OVER (PARTITION BY m.doc_id ORDER BY r.ord) AS rn
        FROM {per_rule} m JOIN {rules(d)} r ON m.rule_id = r.rule_id WHERE m.n_hit = r.n_required AND m.n_bad = 0)"""


def assessments(d: Spark) -> str:
    """Matches with evidence, impact, mitigation, severity and, at medium sensitivity, eligibility."""
    impact = values("category, base_impact", list(IMPACT.items()), d)
    matrix = values("evidence, impact, severity", SEVERITY, d)
    graded = f"""(SELECT m.*, s.in_code, s.in_quote, s.page_id, s.source_type, CASE WHEN m.is_primary THEN 'strong' ELSE 'weak' END AS base_evidence, i.base_impact,
        CASE WHEN m.category = 'sensitive-disclosure' AND m.supporting LIKE '%external-transfer%' THEN 'high' ELSE i.base_impact END AS impact,
        CASE WHEN s.in_code THEN 'code-context' WHEN s.in_quote THEN 'quote-context' ELSE '' END AS mitigation
        FROM {matches(d)} m JOIN {seeded_docs(d)} s ON m.doc_id = s.doc_id JOIN {impact} i ON m.category = i.category WHERE m.rn <= {MATCH_CAP})"""
    lowered = f"""(SELECT g.*, CASE WHEN g.mitigation = '' THEN g.base_evidence WHEN g.base_evidence = 'strong' THEN 'moderate' ELSE 'weak' END AS evidence FROM {graded} g)"""
    return f"""(SELECT l.*, x.severity, x.severity IN ('medium', 'high') AS eligible FROM {lowered} l JOIN {matrix} x ON l.evidence = x.evidence AND l.impact = x.impact)"""


def grouped(d: Spark) -> str:
    """One assessment per action group with a primary match; without any, one per supporting match."""
    rank = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
    # groups of primary matches, and each supporting match by itself, told apart by their first key
    groups = f"""(SELECT doc_id, is_primary, action_group, CASE WHEN is_primary THEN '' ELSE rule_id END AS own, min(rule_id) AS rule_id, max({rank}) AS rank, count(*) AS n_rules, min(category) AS category
        FROM {assessments(d)} a GROUP BY doc_id, is_primary, action_group, CASE WHEN is_primary THEN '' ELSE rule_id END)"""
    told = f"(SELECT g.*, max(CASE WHEN is_primary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS any_primary, {_support(d)} AS support FROM {groups} g)"
    return f"""(SELECT doc_id, action_group, rule_id, rank, CAST(n_rules AS BIGINT) AS n_rules, CASE WHEN is_primary THEN support ELSE '' END AS support FROM {told} t WHERE is_primary OR any_primary = 0)"""


def _support(d: Spark) -> str:
    """The categories of a text's supporting matches, as a window over it."""
    category = "CASE WHEN NOT is_primary THEN category END"
    if d.name == "spark":
        return f"array_join(sort_array(collect_set({category}) OVER (PARTITION BY doc_id)), ',')"
    return f"coalesce(array_to_string(list_sort(list_distinct(list_filter(list({category}) OVER (PARTITION BY doc_id), lambda x: x IS NOT NULL))), ','), '')"


def findings(d: Spark) -> str:
    """Eligible assessments as findings with an identity, counted over a page's documents."""
    return f"""(SELECT page_id, source_type, action_group, min(rule_id) AS rule_id, CAST(count(*) AS BIGINT) AS occurrence_count,
        max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rank, CAST(min(doc_id) AS BIGINT) AS first_doc
        FROM {assessments(d)} a WHERE eligible GROUP BY page_id, source_type, action_group)"""


def custom(d: Spark) -> str:
    return values("literal_id, phrase, short", [(i, p, len(p) <= 2) for i, p in CUSTOM], d)


def custom_hits(d: Spark) -> str:
    """Literals found between characters that are no letters, marks, digits or connectors."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"""(SELECT s.doc_id, c.literal_id, c.short FROM {seeded_docs(d)} s JOIN {custom(d)} c
        ON contains(lower(s.text), c.phrase) AND {d.matches('lower(s.text)', '(^|' + edge + ')(system prompt|the|previous instructions|ab|идти)(' + edge + '|$)')}
        AND regexp_{'like' if d.name == 'spark' else 'matches'}(lower(s.text), '(^|{"[^\\\\p{L}\\\\p{M}\\\\p{N}_]" if d.name == "spark" else edge})' || c.phrase || '({"[^\\\\p{L}\\\\p{M}\\\\p{N}_]" if d.name == "spark" else edge}|$)'))"""


def flags(d: Spark) -> str:
    t = "s.text"
    has = {
        "has_invisible": "[​⁠﻿­]", "has_bidi": "[‪-‮⁦-⁩]", "has_join": "[‌‍]",
        "has_space_run": r"\s\s", "has_latin": r"\p{Latin}" if d.name != "spark" else r"\p{IsLatin}",
        "has_cyrillic": r"\p{Cyrillic}" if d.name != "spark" else r"\p{IsCyrillic}", "has_greek": r"\p{Greek}" if d.name != "spark" else r"\p{IsGreek}",
    }
    return f"SELECT s.doc_id, {', '.join(f'{d.matches(t, p)} AS {n}' for n, p in has.items())} FROM {seeded_docs(d)} s"


#: Scripts of which a text has one as a rule.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Georgian", "Arabic", "Hebrew", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul")


def _s06(d: Spark) -> str:
    """Texts with letters of more than one script; a character that scripts share counts for its own script alone."""
    named = (d.matches("s.text", rf"\p{{Is{x}}}" if d.name == "spark" else rf"\p{{{x}}}") for x in SCRIPTS)
    return f"SELECT doc_id, {' + '.join(f'CASE WHEN {m} THEN 1 ELSE 0 END' for m in named)} > 1 AS mixed_scripts FROM {seeded_docs(d)} s"


def _running(d: Spark) -> str:
    """Texts of a scan in order under the budgets of texts, characters and evaluations of rules: what is analysed.

    The first text beyond a budget ends the scan, so sums of what came before decide.
    """
    scan = d.div("doc_id", str(SCANNED_TOGETHER))
    order = f"PARTITION BY {scan} ORDER BY doc_id"
    sums = f"""(SELECT {scan} AS scan_id, doc_id, row_number() OVER ({order}) AS k,
        sum(length(text)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM {seeded_docs(d)} s)"""
    return f"SELECT scan_id, doc_id, k <= {CANDIDATE_BUDGET} AND total <= {CHAR_BUDGET} AND k * {len(RULES)} <= {EVALUATION_BUDGET} AS analysed FROM {sums} x"


def _snapshot(d: Spark) -> str:
    ranked = f"(SELECT f.*, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, source_type, action_group) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM {findings(d)} f)"
    return f"SELECT page_id, source_type, action_group, rule_id, rn, n > {SNAPSHOT_CAP} AS truncated, CASE WHEN n > {SNAPSHOT_CAP} THEN n - {SNAPSHOT_CAP} ELSE 0 END AS omitted FROM {ranked} r WHERE rn <= {SNAPSHOT_CAP}"


def _state(d: Spark) -> str:
    return f"""SELECT scan_id, CASE WHEN sum(CASE WHEN analysed THEN 0 ELSE 1 END) > 0 THEN 'partial' ELSE 'complete' END AS state,
        CAST(sum(CASE WHEN analysed THEN 0 ELSE 1 END) AS BIGINT) AS left_out FROM ({_running(d)}) r GROUP BY scan_id"""


def _related(d: Spark) -> str:
    """For each literal found in a text: action groups of the primary rules all of whose required signals its own text satisfies."""
    hits = f"(SELECT c.literal_id, p.rule_id, count(DISTINCT p.signal_id) AS n FROM {custom(d)} c JOIN {phrases(d)} p ON p.kind = 'required' AND p.is_primary AND contains(' ' || c.phrase || ' ', ' ' || p.phrase || ' ') GROUP BY c.literal_id, p.rule_id)"
    return f"SELECT c.doc_id, c.literal_id, r.action_group FROM {custom_hits(d)} c LEFT JOIN {hits} h ON c.literal_id = h.literal_id LEFT JOIN {rules(d)} r ON h.rule_id = r.rule_id AND h.n = r.n_required"


QUERIES = {
    "trigger_findings_by_rule": lambda d: f"SELECT rule_id, severity, CAST(count(*) AS BIGINT) AS n FROM {assessments(d)} a GROUP BY rule_id, severity",
    "s02_rule_signals": lambda d: f"SELECT r.rule_id, r.n_required, r.n_optional, r.n_forbidden, count(m.doc_id) AS n_docs FROM {rules(d)} r LEFT JOIN {matches(d)} m ON r.rule_id = m.rule_id GROUP BY r.rule_id, r.n_required, r.n_optional, r.n_forbidden",
    "s04_text_flags": flags,
    "s05_tokens": lambda d: f"SELECT doc_id, {d.size(d.extract_all('lower(text)', TOKEN, 0))} AS n_tokens, length(padded) AS padded_chars FROM {texts(d)} t",
    "s06_mixed_scripts": _s06,
    "s07_rule_classify": lambda d: f"SELECT doc_id, rule_id, supporting FROM {matches(d)} m",
    "s08_match_cap": lambda d: f"SELECT doc_id, rule_id, rn FROM {matches(d)} m WHERE rn <= {MATCH_CAP}",
    "s09_boundary_match": lambda d: f"SELECT doc_id, literal_id FROM {custom_hits(d)} h",
    "s10_phrase_range": lambda d: f"SELECT t.doc_id, t.phrase, length({d.replace('substr(t.padded, 1, instr(t.padded, concat(chr(32), t.phrase, chr(32))))', '[^ ]')}) AS first_token FROM {phrase_hits(d)} t WHERE kind = 'required' GROUP BY ALL",
    "s11_base_evidence": lambda d: f"SELECT doc_id, rule_id, base_evidence FROM {assessments(d)} a",
    "s12_base_impact": lambda d: f"SELECT doc_id, rule_id, base_impact FROM {assessments(d)} a",
    "s13_disclosure_escalation": lambda d: f"SELECT doc_id, rule_id, impact FROM {assessments(d)} a WHERE category = 'sensitive-disclosure'",
    "s14_context_mitigation": lambda d: f"SELECT doc_id, rule_id, evidence, mitigation FROM {assessments(d)} a",
    "s15_severity": lambda d: f"SELECT doc_id, rule_id, severity FROM {assessments(d)} a",
    "s16_short_literal": lambda d: f"SELECT doc_id, literal_id, CASE WHEN short THEN 'low' ELSE 'medium' END AS severity FROM {custom_hits(d)} h",
    "s17_sensitivity": lambda d: f"SELECT s.sensitivity, s.severity, CAST(sum(a.n) AS BIGINT) AS n FROM (SELECT severity, count(*) AS n FROM {assessments(d)} x GROUP BY severity) a JOIN {values('sensitivity, severity', [(k, x) for k, v in SENSITIVITY.items() for x in v], d)} s ON a.severity = s.severity GROUP BY s.sensitivity, s.severity",
    "s18_grouping": lambda d: f"SELECT * FROM {grouped(d)} g",
    "s20_related_groups": _related,
    "s22_literal_cap": lambda d: f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, count(*) > 2 AS partial FROM {custom_hits(d)} h GROUP BY doc_id",
    "s23_envelope": lambda d: f"SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'complete' WHEN length(text) > {LONGEST_CANDIDATE} THEN 'partial' ELSE 'complete' END AS status, length(text) <= {LONGEST_CANDIDATE} AS analysed FROM {seeded_docs(d)} s",
    "s25_catalog": lambda d: f"""SELECT p.rule_id, p.kind, p.signal_id, CAST(count(DISTINCT p.phrase) AS BIGINT) AS n_phrases, CAST(count(DISTINCT h.doc_id) AS BIGINT) AS n_docs FROM {phrases(d)} p
        LEFT JOIN {phrase_hits(d)} h ON p.rule_id = h.rule_id AND p.kind = h.kind AND p.signal_id = h.signal_id AND p.phrase = h.phrase GROUP BY p.rule_id, p.kind, p.signal_id""",
    "t06_eligible_text": lambda d: f"SELECT doc_id, length(trim(text)) > 0 AND {d.matches('text', r'[\p{L}\p{N}]')} AS eligible FROM documents t",
    "t09_scan_budgets": _running,
    "t10_findings": lambda d: f"SELECT doc_id, rule_id, category, severity FROM {assessments(d)} a WHERE eligible",
    "t11_finding_identity": lambda d: f"SELECT page_id, source_type, action_group, rule_id, occurrence_count, first_doc FROM {findings(d)} f",
    "t12_capacity": lambda d: f"SELECT page_id, action_group FROM (SELECT f.*, row_number() OVER (PARTITION BY page_id ORDER BY first_doc, action_group, source_type) AS rn FROM {findings(d)} f) x WHERE rn <= 1000",
    "t13_snapshot_state": _state,
    "t14_snapshot": _snapshot,
}
