"""Request metadata (A), as batch queries; :mod:`pellucid.streaming.requests` has the streaming twin."""

from __future__ import annotations

from pellucid.functions.dialect import Spark
from pellucid.sources.seeds import seeded_requests

# Methods and media types.
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")
DOCUMENT_TYPES = ("text/html", "application/xhtml+xml")
SCRIPT_TYPES = ("application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript", "text/ecmascript", "text/javascript")
# End of the fixed values.

RING, MOST_REDIRECTS, MOST_COUNT = 128, 8, 999
LONGEST_TYPE, LONGEST_MIME = 256, 128


def admitted(d: Spark) -> str:
    """Events of the main frame of one tab, for requests and images."""
    return f"(SELECT * FROM {seeded_requests(d)} e WHERE frame_id = 0 AND tab_id = 1 AND type IN ('xmlhttprequest', 'image'))"


def normalized(d: Spark) -> str:
    """Admitted events with normalised method, status and declared media type."""
    methods = ", ".join(f"'{m}'" for m in METHODS)
    mime = "lower(trim(split_part(content_type, ';', 1)))"
    grammar = d.matches(mime, "^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$")
    return f"""(SELECT a.*, CASE WHEN upper(trim(method)) IN ({methods}) THEN upper(trim(method)) ELSE 'other' END AS norm_method,
        CASE WHEN status_code BETWEEN 100 AND 599 THEN status_code END AS norm_status,
        CASE WHEN content_type IS NULL OR trim(content_type) = '' THEN 'missing' WHEN length(content_type) > {LONGEST_TYPE} OR length({mime}) > {LONGEST_MIME} OR NOT {grammar} THEN 'malformed' ELSE 'valid' END AS mime_state,
        CASE WHEN {grammar} AND length({mime}) <= {LONGEST_MIME} THEN {mime} END AS mime FROM {admitted(d)} a)"""


def observations(d: Spark) -> str:
    """One observation per finished request of a session: what its last headers after a redirect said.

    A request begins with its first ``begin``; events before it are orphans; the first ``completed`` or
    ``error`` after it ends it.
    """
    order = "PARTITION BY session, request_id ORDER BY seq"
    begun = f"(SELECT n.*, min(CASE WHEN kind = 'begin' THEN seq END) OVER (PARTITION BY session, request_id) AS begin_seq FROM {normalized(d)} n)"
    live = f"""(SELECT b.*, min(CASE WHEN seq > begin_seq AND kind IN ('completed', 'error') THEN seq END) OVER (PARTITION BY session, request_id) AS end_seq FROM {begun} b WHERE begin_seq IS NOT NULL)"""
    inside = f"""(SELECT l.*, max(CASE WHEN kind = 'redirect' THEN seq END) OVER (PARTITION BY session, request_id) AS last_redirect
        FROM {live} l WHERE end_seq IS NOT NULL AND seq BETWEEN begin_seq AND end_seq)"""
    headers = f"(SELECT session, request_id, max(CASE WHEN kind = 'headers' AND seq > coalesce(last_redirect, begin_seq) THEN seq END) AS header_seq, min(begin_seq) AS begin_seq, min(end_seq) AS end_seq, CAST(sum(CASE WHEN kind = 'redirect' THEN 1 ELSE 0 END) AS BIGINT) AS redirects FROM {inside} i GROUP BY session, request_id)"
    n = normalized(d)
    return f"""(SELECT h.session, h.request_id, h.end_seq, b.type AS resource_type, b.norm_method AS method, s.norm_status AS response_status, coalesce(s.mime_state, 'missing') AS declared_mime_state, s.mime AS declared_mime,
        e.kind = 'completed' AS completed, e.kind = 'error' AS network_error, h.redirects > 0 AS redirected, h.redirects AS redirect_count
        FROM {headers} h JOIN {n} b ON h.begin_seq = b.seq JOIN {n} e ON h.end_seq = e.seq LEFT JOIN {n} s ON h.header_seq = s.seq WHERE h.redirects <= {MOST_REDIRECTS})"""


def anomalies(d: Spark) -> str:
    """Images that were answered as a document or a script."""
    documents, scripts = (", ".join(f"'{m}'" for m in ms) for ms in (DOCUMENT_TYPES, SCRIPT_TYPES))
    return f"""(SELECT o.*, CASE WHEN declared_mime IN ({documents}) THEN 'document' ELSE 'script' END AS category FROM {observations(d)} o
        WHERE resource_type = 'image' AND completed AND NOT network_error AND declared_mime_state = 'valid' AND response_status BETWEEN 200 AND 299 AND response_status NOT IN (204, 205) AND declared_mime IN ({documents}, {scripts}))"""


def single_anomalies(d: Spark) -> str:
    """The same test on each event by itself, so that every table has some."""
    documents, scripts = (", ".join(f"'{m}'" for m in ms) for ms in (DOCUMENT_TYPES, SCRIPT_TYPES))
    return f"""(SELECT n.*, CASE WHEN mime IN ({documents}) THEN 'document' ELSE 'script' END AS category FROM {normalized(d)} n
        WHERE type = 'image' AND kind = 'completed' AND mime_state = 'valid' AND norm_status BETWEEN 200 AND 299 AND norm_status NOT IN (204, 205) AND mime IN ({documents}, {scripts}))"""


def _by_revision(d: Spark, s: str) -> str:
    """Counts of anomalies ``s`` by category in the newest revision of each tab's requester; older ones are counted as late."""
    newest = f"(SELECT request_id % 10 AS tab, max(session) AS revision FROM {s} m GROUP BY request_id % 10)"
    return f"""SELECT n.tab, n.revision, CAST(least(sum(CASE WHEN s.session = n.revision AND s.category = 'document' THEN 1 ELSE 0 END), {MOST_COUNT}) AS BIGINT) AS documents,
        CAST(least(sum(CASE WHEN s.session = n.revision AND s.category = 'script' THEN 1 ELSE 0 END), {MOST_COUNT}) AS BIGINT) AS scripts, CAST(sum(CASE WHEN s.session < n.revision THEN 1 ELSE 0 END) AS BIGINT) AS late
        FROM {s} s JOIN {newest} n ON s.request_id % 10 = n.tab GROUP BY n.tab, n.revision"""


QUERIES = {
    "a01_admission": lambda d: f"SELECT seq, session, request_id, kind FROM {admitted(d)} a",
    "a02_request_assembly": lambda d: f"SELECT session, request_id, end_seq, completed, redirect_count FROM {observations(d)} o",
    "a03_ring": lambda d: f"SELECT session, seq FROM (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rn FROM {admitted(d)} a) r WHERE rn <= {RING}",
    "a04_method": lambda d: f"SELECT norm_method, CAST(count(*) AS BIGINT) AS n FROM {normalized(d)} x GROUP BY norm_method",
    "a05_status": lambda d: f"SELECT norm_status, CAST(count(*) AS BIGINT) AS n FROM {normalized(d)} x GROUP BY norm_status",
    "a06_content_type": lambda d: f"SELECT mime_state, CAST(count(*) AS BIGINT) AS n FROM {normalized(d)} x GROUP BY mime_state",
    "a07_mime": lambda d: f"SELECT seq, mime FROM {normalized(d)} x",
    "a08_observation": lambda d: f"SELECT * FROM {observations(d)} o",
    "a09_image_anomaly": lambda d: f"SELECT seq, session, category FROM {single_anomalies(d)} x",
    "a09b_assembled_anomaly": lambda d: f"SELECT session, request_id, category FROM {anomalies(d)} x",
    "a10_by_revision": lambda d: _by_revision(d, single_anomalies(d)),
    "a10_assembled_by_revision": lambda d: _by_revision(d, anomalies(d)),
    "a11_assembled_snapshot": lambda d: f"SELECT session, category, CAST(least(count(*), {MOST_COUNT}) AS BIGINT) AS n FROM {anomalies(d)} x GROUP BY session, category",
    "a11_candidate_snapshot": lambda d: f"SELECT session, category, CAST(count(*) AS BIGINT) AS n FROM {single_anomalies(d)} x GROUP BY session, category",
    "a14_api_surface": lambda d: f"SELECT page_id, {d.size(d.extract_all('lower(html)', '(?:action|src|data-api|href)=\"[^\"]*(?:api|/v1/|/graphql)', 0))} AS n FROM pages WHERE html IS NOT NULL",
}
