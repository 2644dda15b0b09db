"""SQL of the cell faults and of the line rejects, written for DuckDB independently of the operators."""

from __future__ import annotations

_TZ = "(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_TIME = r"T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
_DAY = "[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
_KINDS = ("integer", "decimal", "double", "boolean", "date", "dateTime")


def _valid(kind: str, c: str) -> str:
    full = lambda p: f"regexp_full_match({c}, '{p}')"
    if kind == "boolean":
        return f"{c} IN ('true', 'false', '1', '0')"
    if kind in ("date", "dateTime"):
        return f"({full(_DAY + (_TIME if kind == 'dateTime' else '') + _TZ)} AND try_cast(left({c}, 10) AS DATE) IS NOT NULL)"
    return full({"integer": "[+-]?[0-9]+", "decimal": _NUMBER, "double": f"({_NUMBER})([eE][+-]?[0-9]+)?|[+-]?INF|NaN"}[kind])


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


# the written time less its zone, as the text of the instant with its fraction
_INSTANT = r"""strftime(CAST(left(t, 10) AS TIMESTAMP) + to_hours(CAST(t[12:13] AS INT)) + to_minutes(CAST(t[15:16] AS INT)) + to_seconds(CAST(t[18:19] AS INT))
  - to_minutes(CASE WHEN regexp_matches(t, '[+-][0-9]{2}:[0-9]{2}$') THEN (CAST(right(t, 5)[1:2] AS INT) * 60 + CAST(right(t, 2) AS INT)) * CASE WHEN left(right(t, 6), 1) = '-' THEN -1 ELSE 1 END ELSE 0 END), '%Y-%m-%d %H:%M:%S')
  || rtrim(regexp_extract(t, '\.([0-9]+)', 1), '0')"""

CELL_FAULTS = f"""WITH d AS (SELECT DISTINCT p, value_type FROM predicates),
r AS (SELECT s.v AS subj, a.p AS pred, value_type AS vt, o.k AS k, o.v AS v, {_strip('o.v')} AS t FROM attr_quads a JOIN d ON d.p = a.p WHERE s.v IS NOT NULL),
c AS (SELECT subj, pred, CASE
  WHEN vt = 'xsd:anyURI' THEN CASE WHEN k = 1 THEN v END
  WHEN k <> 2 THEN NULL
  WHEN vt = 'xsd:string' THEN v
  WHEN vt = 'xsd:integer' THEN CASE WHEN {_valid('integer', 't')} THEN CAST(CAST(t AS HUGEINT) AS VARCHAR) END
  WHEN vt = 'xsd:decimal' THEN CASE WHEN {_valid('decimal', 't')} THEN CAST(CAST(t AS DECIMAL(38, 12)) AS VARCHAR) END
  WHEN vt = 'xsd:double' THEN CASE WHEN {_valid('double', 't')} THEN CAST(CAST(replace(t, 'INF', 'inf') AS DOUBLE) + 0 AS VARCHAR) END
  WHEN vt = 'xsd:boolean' THEN CASE WHEN t IN ('true', '1') THEN 'true' WHEN t IN ('false', '0') THEN 'false' END
  WHEN vt = 'xsd:date' THEN CASE WHEN {_valid('date', 't')} THEN left(t, 10) END
  WHEN vt = 'xsd:dateTime' THEN CASE WHEN {_valid('dateTime', 't')} THEN {_INSTANT} END
  END AS canon FROM r)
SELECT subj, pred, CASE WHEN count(canon) = 0 THEN 'untypable' ELSE 'conflict' END AS kind FROM c GROUP BY subj, pred HAVING count(canon) = 0 OR count(DISTINCT canon) > 1"""

_BODY = r"""<[^>]*>|_:[A-Za-z0-9]+|"(?:[^"\\]|\\.)*"(?:@[^ \t.<"#]*|\^\^<[^>]*>)?"""
_TERM, _BARE = f"({_BODY})", f"(?:{_BODY})"
_COMMENT = r"[ \t]*(?:#.*)?"
_SHAPE = r"(?s)[ \t]*(?:" + _BARE + r"[ \t]*){N}\." + _COMMENT
_PARTS = r"(?s)^[ \t]*" + r"[ \t]*".join([_TERM] * 3) + r"[ \t]*" + _TERM + "?"
_IRI = r"""<[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20\x7F-\x{9F}<>"{}|^`\\]*>"""
_KNOWN_ESCAPES = r"""(?s)(?:[^\\]|\\[tbnrf"''\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*"""
_LITERAL_BODY = "regexp_extract(x.o, '(?s)^\"(.*)\"[^\"]*$', 1)"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_BAD_TEXT = " OR ".join(f"(dt IN ('<xsd:{k}>', '<{_XSD}{k}>') AND NOT {_valid(k, 'txt')})" for k in _KINDS)
_BAD_IRIS = " OR ".join(f"(left(x.{c}, 1) = '<' AND NOT regexp_full_match(x.{c}, '{_IRI}'))" for c in "spog")
_SPACE = "' ' || chr(9) || chr(10) || chr(13)"

LINE_REJECTS = rf"""WITH l AS (SELECT line_id, line, regexp_matches(coalesce(path, ''), '\.(nt|nq)(\.gz)?$') AS known, regexp_matches(coalesce(path, ''), '\.nq(\.gz)?$') AS quads
  FROM rdf_lines WHERE line IS NOT NULL AND trim(line, {_SPACE}) <> '' AND left(trim(line, {_SPACE}), 1) <> '#'),
m AS (SELECT *, regexp_full_match(line, '(?s)(?:[ \t.]|{_BARE})*(?:#.*)?') AS readable,
  regexp_full_match(line, '{_SHAPE.replace("N", "3", 1)}') OR (quads AND regexp_full_match(line, '{_SHAPE.replace("N", "4", 1)}')) AS shaped FROM l),
t AS (SELECT *, regexp_extract(line, '{_PARTS}', ['s', 'p', 'o', 'g']) AS x FROM m),
e AS (SELECT *, {_LITERAL_BODY} AS body, {_strip(_LITERAL_BODY)} AS txt, regexp_matches(x.o, '"@[^"]*$') AS tagged, regexp_extract(x.o, '"@([^"]*)$', 1) AS tag, regexp_extract(x.o, '"\^\^(<[^"]*>)$', 1) AS dt FROM t)
SELECT line_id, CASE WHEN NOT known THEN 'unknown_format' WHEN NOT readable THEN 'quoting' WHEN NOT shaped THEN 'columns' ELSE 'value' END AS reason FROM e
WHERE NOT known OR NOT readable OR NOT shaped OR left(x.s, 1) = '"' OR left(x.p, 1) IN ('"', '_') OR left(x.g, 1) = '"' OR {_BAD_IRIS}
  OR (left(x.o, 1) = '"' AND (NOT regexp_full_match(body, '{_KNOWN_ESCAPES}') OR (tagged AND NOT regexp_full_match(tag, '[A-Za-z]+(-[A-Za-z0-9]+)*'))
    OR (NOT tagged AND dt <> '' AND (NOT regexp_full_match(dt, '{_IRI}') OR {_BAD_TEXT}))))"""


# fixed values: the declared columns and their types
_WIDE = """kind anyURI; title string; call_sign string; remark string; keeper anyURI; built_by anyURI; stationed_at anyURI; decks integer; crew_max integer; plate_no integer; mass_tonnes decimal; day_rate decimal;
beam_metres decimal; engine_load double; drift_coef double; armed boolean; in_service boolean; insured boolean; launched_on date; surveyed_on date; last_ping dateTime; last_fuel dateTime; alt_name string; reserve integer"""
_TYPED = {
    "anyURI": "v", "string": "v", "integer": "try_cast(t AS DECIMAL(38, 0))", "decimal": "try_cast(t AS DECIMAL(38, 18))", "double": "CAST(replace(t, 'INF', 'inf') AS DOUBLE) + 0", "boolean": "t IN ('true', '1')",
    "date": "try_cast(left(t, 10) AS DATE)", "dateTime": "CAST(left(canon, 19) AS TIMESTAMP) + to_microseconds(CAST(rpad(left(canon[20:], 6), 6, '0') AS BIGINT))",
}
_COLUMNS = [x.split() for x in _WIDE.replace("\n", " ").split(";")]
_CELLS = CELL_FAULTS[: CELL_FAULTS.index("SELECT subj, pred, CASE WHEN count(canon)")]
_CELLS = _CELLS.replace("SELECT DISTINCT p, value_type FROM", "SELECT DISTINCT p, value_type, col_name FROM").replace("s.v AS subj,", "s.v AS subj, col_name, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS loaded, row_id,").replace("SELECT subj, pred, CASE", "SELECT *, CASE")
WIDE = f"""{_CELLS}, latest AS (SELECT * FROM c WHERE canon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subj, col_name ORDER BY loaded DESC, row_id DESC) = 1)
SELECT c.subj, {", ".join(f"any_value(CASE WHEN l.col_name = '{n}' THEN {_TYPED[t]} END) AS {n}".replace("canon", "l.canon").replace("(t ", "(l.t ").replace("(t,", "(l.t,").replace("left(t", "left(l.t").replace("THEN t ", "THEN l.t ").replace("THEN v ", "THEN l.v ") for n, t in _COLUMNS)}
FROM (SELECT DISTINCT subj FROM c) c LEFT JOIN latest l ON l.subj = c.subj GROUP BY c.subj"""

_CHARS = (("t", "chr(9)"), ("b", "chr(8)"), ("n", "chr(10)"), ("r", "chr(13)"), ("f", "chr(12)"))
_PLAIN = r"CASE WHEN left(x, 2) IN ('\u', '\U') AND length(x) > 2 THEN chr(CAST('0x' || x[3:] AS INT)) " + " ".join(rf"WHEN x = '\{a}' THEN {b}" for a, b in _CHARS) + r" WHEN left(x, 1) = '\' THEN x[2:] ELSE x END"
_TEXT = r"array_to_string(list_transform(regexp_extract_all(body, '(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+'), lambda x: " + _PLAIN + "), '')"
_HEAD, _TAIL = LINE_REJECTS.split("SELECT line_id, CASE WHEN NOT known")
_IRI_OF = "CASE WHEN left(x.{0}, 1) = '<' THEN substring(x.{0}, 2, length(x.{0}) - 2)"
LOADED = f"""{_HEAD}SELECT line_id, {_IRI_OF.format('s')} END AS s, {_IRI_OF.format('p')} END AS p, {_IRI_OF.format('o')} WHEN left(x.o, 1) = '"' THEN {_TEXT} END AS o,
  CASE WHEN left(x.o, 1) <> '"' THEN NULL WHEN tagged THEN 'rdf:langString' WHEN dt = '' THEN 'xsd:string' ELSE replace(substring(dt, 2, length(dt) - 2), '{_XSD}', 'xsd:') END AS dt,
  CASE WHEN left(x.o, 1) = '"' AND tagged THEN lower(tag) END AS lang, {_IRI_OF.format('g')} END AS g FROM e WHERE ({_TAIL[_TAIL.index('WHERE') + 5:]}) IS NOT TRUE"""
