"""Link targets, hostnames and captions (L)."""

from __future__ import annotations

from importlib import resources

from pellucid.functions import punycode
from pellucid.functions.dialect import Spark
from pellucid.sources.seeds import seeded_links

# Parameter names, protocols, look-alike letters, zones and file endings.
REDIRECT_KEYS = ("url", "target", "dest", "destination", "redirect", "next", "continue")
HIGH_PROTOCOLS, MEDIUM_PROTOCOLS = ("javascript", "vbscript"), ("data", "file")
LOOKALIKES = "аеорсхуіјѕԁԛԝӏѵԍһ" + "οαρνιχϲευϳ"
LATIN_LOOKALIKES = "ɡɟɪɩʏʙʜɴʀʟɑɐɢʁɜɹʇʞ" + "ᴀᴄᴅᴇᴋᴍᴏᴘᴛᴜᴠᴡᴢᴊ"
ZONES = """
com net org info biz edu gov mil
app dev page site online store shop tech cloud blog news live top xyz club fun life world space
website digital wiki art icu vip link click work today best
рф рус москва дети онлайн сайт бел укр қаз срб мкд ею
中国 中國 公司 网络 台湾 台灣 香港 新加坡 商城 网站 在线 我爱你
한국 日本 みんな コム インド भारत বাংলা ভারত ਭਾਰਤ ભારત இந்தியா భారత్ ಭಾರತ ලංකා ไทย
مصر السعودية الاردن المغرب امارات ايران عمان قطر بھارت پاکستان سورية تونس شبكة موقع كوم عرب
ישראל קום
"""
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Tamil", "Armenian", "Georgian")
MIXING = ("Latin", "Cyrillic", "Greek")
FILE_ENDINGS = "ai apk asp aspx avi bak bat bmp css csv dll dmg doc docx dtd eot exe flv gif gz htm html ico iso jar jpeg jpg js json jsp log md mov mp mpeg mpg msi odt otf pdf php png ppt pptx psd py rar rb rtf sh so sql svg tar tgz tiff tmp ttf txt wav webp xls xlsx xml yaml yml zip"
WRAPPERS = ("()", "[]", "{}", '""', "''", "«»", "“”", "‘’")
# End of the fixed values.

#: Zones of countries: the two-letter codes of ISO 3166 that the time-zone database lists, and three that are in use besides.
COUNTRIES = sorted({"eu", "su", "uk"} | {line[:2].lower() for line in resources.files("tzdata.zoneinfo").joinpath("iso3166.tab").read_text(encoding="utf-8").splitlines() if line and not line.startswith("#")})

NOT_ASCII = r"[^\x00-\x7F]"
LONGEST_TARGET, OPAQUE_CHARS, CAPTION_HOSTS, RING, DEDUPE_KEYS, WRAPPER_DEPTH = 8_192, 12, 8, 20, 5_000, 8


def _script(d: Spark, name: str) -> str:
    return rf"\p{{Is{name}}}" if d.name == "spark" else rf"\p{{{name}}}"


def targets(d: Spark) -> str:
    """Targets to inspect: scheme, host (of the document's base for relative ones) and query.

    The base is the page's address, or its base element's if that is absolute or names a host.
    """
    t, at = "trim(href)", "^(?:https?:)?//([^/?#]+)"
    page, base = (d.extract(e, "^[A-Za-z]+://([^/?#:]+)") for e in ("page_url", "base_url"))
    scheme = d.extract(t, "^([A-Za-z][A-Za-z0-9+.-]*):")
    named = d.replace(f"lower({d.extract(t, at)})", "^.*@|:[0-9]*$")
    linked = f"(SELECT l.*, CASE WHEN {d.matches('base_href', '^https?://')} THEN base_href WHEN base_href LIKE '//%' THEN concat({d.extract('page_url', '^([A-Za-z]+:)')}, base_href) ELSE page_url END AS base_url FROM {seeded_links(d)} l)"
    return f"""(SELECT x.*, lower({scheme}) AS scheme, lower({page}) AS page_host, lower({base}) AS base_host,
        CASE WHEN {d.matches(t, '^([hH][tT][tT][pP][sS]?:)?//')} THEN {named.replace("https?", "[hH][tT][tT][pP][sS]?")} WHEN {scheme} <> '' THEN '' ELSE lower({base}) END AS host, {d.extract(t, '[?]([^#]*)')} AS query
        FROM {linked} x WHERE {t} <> '' AND {t} NOT LIKE '#%' AND length(href) <= {LONGEST_TARGET})"""


def base_origins(d: Spark) -> str:
    """Pages whose base element leads to another origin: scheme, host and port, those that go without saying left out."""
    origin = lambda e: d.replace("lower(" + d.extract(e, "^([A-Za-z]+://[^/?#]+)") + ")", "(:80|:443)$")
    pages = f"(SELECT DISTINCT page_id, page_url, base_url FROM {targets(d)} t)"
    return f"(SELECT page_id, {origin('base_url')} AS base_origin, {origin('page_url')} AS page_origin FROM {pages} p WHERE {origin('base_url')} <> {origin('page_url')})"


def parameters(d: Spark) -> str:
    """Redirect parameters in order, their decoded values and what they lead to."""
    pairs = d.unnest(f"(SELECT * FROM {targets(d)} q WHERE query <> '')", d.split("query", "&"))
    named = f"""(SELECT page_id, ord, page_host, host, pos, lower(split_part(val, '=', 1)) AS name, {d.unquote("substr(val, instr(val, '=') + 1)")} AS dest
        FROM {pairs} p WHERE val LIKE '%=%')"""
    keys = ", ".join(f"'{k}'" for k in REDIRECT_KEYS)
    at = f"lower({d.extract('dest', '^(?:https?:)?//([^/?#:]+)')})"
    return f"""(SELECT n.*, {d.matches('dest', '^(https?://|//|/|[.]/|[.][.]/|[?])')} AS is_url, CASE WHEN NOT {d.matches('dest', '^(https?://|//|/|[.]/|[.][.]/|[?])')} THEN 'unknown'
        WHEN {at} = '' OR {at} = host THEN 'same-host' ELSE 'external' END AS leads FROM {named} n WHERE name IN ({keys}) AND trim(dest) <> '')"""


def opaque(d: Spark) -> str:
    return f"(SELECT * FROM {signals(d)} s WHERE leads = 'unknown')"


def signals(d: Spark) -> str:
    """Signs that an unknown destination is a URL in disguise: encoded twice, a host alone, or base64 of an address."""
    plain = "replace(translate(dest, '-_', '+/'), '=', '')"
    decoded = d.unbase64(f"concat({plain}, repeat('=', (4 - length({plain}) % 4) % 4))")
    host = f"NOT {d.matches('dest', '[' + chr(92) + 's/?#@:]')} AND {domain_like(d, 'lower(dest)')} AND {plausible_zone(d, 'lower(dest)')}"
    return f"""(SELECT p.*, length(dest) >= {OPAQUE_CHARS} AND {d.matches('lower(dest)', '%25(?:2f|3a)|%3a%2f%2f|%2f%2f|https?%3a')} AS encoded_url, {host} AS bare_hostname,
        CASE WHEN {d.matches('dest', '^[A-Za-z0-9+/_-]{16,}={0,2}$')} THEN coalesce({decoded} LIKE '%://%', false) ELSE false END AS base64_url FROM {parameters(d)} p)"""


def domain_like(d: Spark, e: str) -> str:
    return d.matches(e, r"^([\p{L}\p{N}]([\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?[.])+[\p{L}]{2,}$")


def plausible_zone(d: Spark, e: str) -> str:
    """Whether a host ends in a known zone that is no file ending."""
    zones, endings = (", ".join(f"'{z}'" for z in zs) for zs in ([*ZONES.split(), *COUNTRIES], FILE_ENDINGS.split()))
    zone = d.extract(e, "[.]([^.]+)$")
    return f"({zone} IN ({zones}) AND NOT {zone} IN ({endings}))"


def hosts(d: Spark) -> str:
    """Distinct hosts of targets and pages, their labels and those in characters; local names, single labels and addresses are left out."""
    found = f"(SELECT host FROM {targets(d)} t UNION SELECT page_host FROM {targets(d)} p)"
    kept = f"""(SELECT host, {d.split('host', '[.]')} AS labels FROM {found} h
        WHERE host <> '' AND host <> 'localhost' AND host LIKE '%.%' AND NOT {d.matches('host', '^[0-9.]+$')} AND host NOT LIKE '[%')"""
    # grouped, so that the decoding is not repeated in what is made of it; rows are dealt by host already
    read = f"(SELECT host, any_value(labels) AS labels, any_value({d.apply('labels', punycode.decoded(d, 'x'))}) AS decoded FROM {kept} k GROUP BY host)"
    last = f"({d.size('labels')} - 1)"
    return f"(SELECT r.*, {d.slice('decoded', f'CAST({last} AS INT)')} AS names, {d.last('decoded')} AS zone, {d.matches(d.last('labels'), '^xn--')} OR {d.matches(d.last('decoded'), NOT_ASCII)} AS idn_zone FROM {read} r)"


def _scripts(d: Spark, e: str) -> str:
    """A label's scripts in the order of SCRIPTS, one comma behind each; letters of none of them are ``other``."""
    found = " || ".join(f"CASE WHEN {d.matches(e, _script(d, s))} THEN '{s.lower()},' ELSE '' END" for s in SCRIPTS)
    return d.let(found, "f", f"CASE WHEN f = '' AND {d.matches(e, '[' + chr(92) + 'p{L}]')} THEN 'other,' ELSE f END")


def labels(d: Spark) -> str:
    """One row per label of a host, with its scripts."""
    rows = d.unnest(f"(SELECT host, decoded, {d.size('decoded')} AS n FROM {hosts(d)} h)", "decoded")
    return f"(SELECT host, pos, pos = n AS is_zone, val AS label, {_scripts(d, 'val')} AS scripts FROM {rows} u)"


def _foreign_scripts(d: Spark) -> str:
    """Whether a label x has a script that the zone has not."""
    shared = [f"{d.matches('x', _script(d, s))} AND NOT {d.matches('zone', _script(d, s))}" for s in SCRIPTS]
    none = " AND ".join(f"NOT {d.matches('x', _script(d, s))}" for s in SCRIPTS)
    zone_other = " OR ".join(d.matches("zone", _script(d, s)) for s in SCRIPTS)
    letter = "[" + chr(92) + "p{L}]"
    return f"({' OR '.join(f'({t})' for t in shared)} OR ({none} AND {d.matches('x', letter)} AND ({zone_other})))"


def host_signals(d: Spark) -> str:
    count = " + ".join(f"CASE WHEN {d.matches('x', _script(d, s))} THEN 1 ELSE 0 END" for s in MIXING)
    letters = d.replace("x", r"[^\p{L}]")
    lookalike = f"{d.matches(letters, '^[' + LOOKALIKES + ']{4,}$')}"
    written = d.matches("x", NOT_ASCII)
    foreign = f"NOT idn_zone OR NOT {d.any_of('names', written)} OR {d.any_of('names', f'{written} AND {_foreign_scripts(d)}')}"
    encoded = d.any_of("labels", f"x LIKE 'xn--%' OR {written}")
    flags = {
        "has_punycode": encoded, "mixed_script": d.any_of("decoded", f"({count}) > 1"), "whole_script": f"NOT idn_zone AND {d.any_of('names', lookalike)}",
        "latin_lookalike": d.any_of("names", d.matches("x", "[" + LATIN_LOOKALIKES + "]") + " AND " + d.matches("x", "[a-zA-Z0-9]")), "zone_mismatch": f"{encoded} AND ({foreign})",
    }
    return f"""(SELECT host, any_value(decoded) AS decoded, any_value(idn_zone) AS idn_zone, {', '.join(f'any_value({e}) AS {name}' for name, e in flags.items())} FROM {hosts(d)} h GROUP BY host)"""


def host_findings(d: Spark) -> str:
    s = host_signals(d)
    found = f"""(SELECT h.*, {d.array("CASE WHEN mixed_script THEN 'mixed-script' END", "CASE WHEN whole_script OR latin_lookalike THEN 'confusable' END",
        "CASE WHEN zone_mismatch AND NOT (mixed_script OR whole_script OR latin_lookalike) THEN 'punycode' END")} AS types FROM {s} h)"""
    return f"(SELECT host, val AS type, CASE WHEN val = 'punycode' THEN 'low' ELSE 'high' END AS severity FROM {d.unnest(found, 'types')} u WHERE val IS NOT NULL)"


def captions(d: Spark) -> str:
    """Captions without white-space runs, marks at the end and matched wrappers (eight deep at most), in lower case."""
    pairs = ", ".join(d.text(p) for p in WRAPPERS)
    bare = f"CASE WHEN length(x) >= 2 AND substr(x, 1, 1) || substr(x, length(x), 1) IN ({pairs}) THEN trim(substr(x, 2, length(x) - 2)) ELSE x END"
    marks = "[.,;:!?]+$"
    e = f"trim({d.replace('trim(' + d.replace('caption', r'\s+', ' ') + ')', marks)})"
    for _ in range(WRAPPER_DEPTH):
        # the lambda's variable stands for what is made so far, which is so written only once
        e = d.at(d.apply(d.array(e), bare), 1)
    e = f"trim({d.replace(e, marks)})"
    return f"(SELECT t.page_id, t.ord, t.scheme, t.host, t.page_host, t.caption AS raw_caption, lower({e}) AS caption FROM {targets(d)} t)"


def caption_hosts(d: Spark) -> str:
    parts = d.slice(d.keep(d.split("caption", r"[\s,;]+"), "x LIKE '%.%'"), CAPTION_HOSTS)
    bare = d.replace(d.replace("val", "^(https?:)?//"), "[/?#].*$")
    clean = d.replace(d.replace(d.replace(bare, r"^[(\x22'«“‘\[{]+"), r"[)\x22'»”’\]}.,;:!?]+$"), r"^www[.]")
    rows = f"(SELECT page_id, ord, scheme, host, raw_caption, pos, {clean} AS named FROM {d.unnest(captions(d), parts)} u)"
    return f"(SELECT r.*, {domain_like(d, 'named')} AS domain_like, {plausible_zone(d, 'named')} AS plausible_tld FROM {rows} r)"


def mismatches(d: Spark) -> str:
    """Links whose caption names hosts none of which is the target or a parent of it."""
    shown = f"(SELECT * FROM {caption_hosts(d)} c WHERE domain_like AND plausible_tld AND scheme IN ('http', 'https', ''))"
    target = d.replace("host", r"^www[.]")
    return f"""(SELECT page_id, ord, host, min(CASE WHEN {target} = named OR {target} LIKE concat('%.', named) THEN 0 ELSE 1 END) = 1 AS mismatch, CAST(count(*) AS BIGINT) AS n_named
        FROM {shown} s WHERE host <> '' GROUP BY page_id, ord, host)"""


def unsafe(d: Spark) -> str:
    high, medium = (", ".join(f"'{p}'" for p in ps) for ps in (HIGH_PROTOCOLS, MEDIUM_PROTOCOLS))
    return f"(SELECT page_id, ord, 'unsafe-protocol' AS type, CASE WHEN scheme IN ({high}) THEN 'high' ELSE 'medium' END AS severity, concat('protocol|', substr(href, 1, 96)) AS dedupe_key FROM {targets(d)} t WHERE scheme IN ({high}, {medium}))"


def redirects(d: Spark) -> str:
    """Links whose parameters lead elsewhere, or to what can't be told: the parameters are read once."""
    strange = "leads = 'unknown' AND (encoded_url OR bare_hostname OR base64_url)"
    found = f"""(SELECT page_id, ord, host, min(CASE WHEN leads = 'external' THEN pos END) AS ext, min(CASE WHEN {strange} THEN pos END) AS odd
        FROM {signals(d)} r GROUP BY page_id, ord, host)"""
    return f"(SELECT page_id, ord, 'redirect' AS type, CASE WHEN ext IS NOT NULL THEN 'medium' ELSE 'low' END AS severity, concat('redirect|', host) AS dedupe_key FROM {found} r WHERE ext IS NOT NULL OR odd IS NOT NULL)"


def findings(d: Spark) -> str:
    """All findings of links, with the key by which a page's repeats are dropped."""
    named = f"(SELECT DISTINCT page_id, CASE WHEN val = 1 THEN ord ELSE CAST(0 AS BIGINT) END AS ord, CASE WHEN val = 1 THEN host ELSE page_host END AS host FROM {d.unnest(targets(d), d.array('1', '2'))} t)"
    every = f"""(SELECT * FROM {unsafe(d)} u UNION ALL SELECT * FROM {redirects(d)} r
        UNION ALL SELECT page_id, ord, 'link-mismatch', 'high', concat('mismatch|', host) FROM {mismatches(d)} m WHERE mismatch
        UNION ALL SELECT page_id, CAST(0 AS BIGINT), 'base-origin-mismatch', 'high', concat('base|', base_origin) FROM {base_origins(d)} b
        UNION ALL SELECT t.page_id, t.ord, f.type, f.severity, concat(f.type, '|', f.host) FROM {named} t JOIN {host_findings(d)} f ON t.host = f.host)"""
    return f"""(SELECT page_id, ord, type, severity, dedupe_key, rn FROM (SELECT e.*, row_number() OVER (PARTITION BY page_id, dedupe_key ORDER BY ord, type) AS rn FROM {every} e) x)"""


def _ring(d: Spark) -> str:
    rows = f"(SELECT f.*, row_number() OVER (PARTITION BY page_id ORDER BY ord DESC, type DESC) AS recent FROM {findings(d)} f WHERE rn = 1)"
    return f"SELECT page_id, type, severity, ord, recent FROM {rows} r WHERE recent <= {RING} AND recent <= 10"


QUERIES = {
    "l01_targets": lambda d: f"SELECT page_id, ord, href, scheme, host FROM {targets(d)} t",
    "foreign_hosts": lambda d: f"SELECT page_id, ord, host, page_host, host <> '' AND host <> page_host AS foreign_origin FROM {targets(d)} t",
    "l03_base_resolution": lambda d: f"SELECT page_id, ord, scheme, base_host, host FROM {targets(d)} t",
    "l04_foreign_base": lambda d: f"SELECT page_id, base_origin, page_origin, 'high' AS severity FROM {base_origins(d)} b",
    "l05_unsafe_protocol": lambda d: f"SELECT page_id, ord, type, severity FROM {unsafe(d)} f",
    "l06_redirect_parameters": lambda d: f"SELECT page_id, ord, name, dest, leads FROM {parameters(d)} p",
    "l07_destination_gate": lambda d: f"SELECT page_id, ord, pos, is_url FROM {parameters(d)} p",
    "l08_opaque_signals": lambda d: f"SELECT page_id, ord, pos, encoded_url, bare_hostname, base64_url FROM {opaque(d)} p",
    "l09_redirect_finding": lambda d: f"SELECT page_id, ord, severity FROM {redirects(d)} f",
    "l10_hostname_exclusion": lambda d: f"SELECT host, {d.size('labels')} AS n_labels FROM {hosts(d)} h",
    "l12_label_scripts": lambda d: f"SELECT host, pos, is_zone, label, scripts FROM {labels(d)} s",
    "l13_mixed_script": lambda d: f"SELECT host, mixed_script FROM {host_signals(d)} s",
    "l14_whole_script": lambda d: f"SELECT host, whole_script FROM {host_signals(d)} s",
    "l15_latin_lookalike": lambda d: f"SELECT host, latin_lookalike FROM {host_signals(d)} s",
    "idn_zones": lambda d: f"SELECT host, idn_zone, has_punycode FROM {host_signals(d)} s",
    "l16_zone_mismatch": lambda d: f"SELECT host, zone_mismatch FROM {host_signals(d)} s",
    "l17_host_analysis": lambda d: f"SELECT host, {d.join_array('decoded', '.')} AS decoded_host, idn_zone, has_punycode, mixed_script, whole_script, latin_lookalike, zone_mismatch FROM {host_signals(d)} s",
    "l18_hostname_findings": lambda d: f"SELECT host, type, severity FROM {host_findings(d)} f",
    "l19_caption": lambda d: f"SELECT page_id, ord, caption FROM {captions(d)} c",
    "l20_caption_hosts": lambda d: f"SELECT page_id, ord, pos, named FROM {caption_hosts(d)} c",
    "l21_domain_like": lambda d: f"SELECT page_id, ord, named, domain_like FROM {caption_hosts(d)} c",
    "l22_plausible_tld": lambda d: f"SELECT page_id, ord, named, plausible_tld FROM {caption_hosts(d)} c",
    "l23_mismatch": lambda d: f"SELECT page_id, ord, host, mismatch, n_named FROM {mismatches(d)} m",
    "l24_dedupe": lambda d: f"SELECT page_id, type, dedupe_key, ord FROM {findings(d)} f WHERE rn = 1",
    "l25_distinct_hosts": lambda d: f"SELECT host, CAST(count(*) AS BIGINT) AS n_links FROM {targets(d)} t WHERE host <> '' GROUP BY host",
    "l26_coverage": lambda d: f"SELECT page_id, count(*) > 3000 AS budget_reached, CAST(count(*) AS BIGINT) AS n_targets FROM {targets(d)} t GROUP BY page_id",
    "l27_recent": _ring,
}
