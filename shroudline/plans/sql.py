"""Derived inputs as SQL, for checking.

The driver tables hold few sensitive values, so the checked queries read texts with one more value
appended per row, chosen by ``doc_id``.  Expressions shared by both engines are written once.
"""

from __future__ import annotations

import re

from shroudline.config import DEFAULT_ENTROPY, DEFAULT_RULES, LOCAL_PRINCIPAL, Principal

# Callers of the example configuration (secrets are the plain words in the name).
CALLERS = (
    Principal("demo-app", "engineering", "employee", "internal",
              "cd577fe2561ebff23505db0bb006300c7cdecbd46bc0e03c449afafaca2c25bf", ("email",)),
    Principal("security-admin", "secops", "admin", "restricted",
              "16175223c8ddce5ace0493c948569c211b03c4c6bb3d3e484434999448cffe01",
              ("email", "phone", "national_id", "ip_address", "mac_address", "imei", "vin", "bank_card", "api_key",
               "bearer_token")),
    Principal("privileged-analyst", "security", "employee", "restricted",
              "dee3b81e0a480f7d88c15b8239f18e77f3107918874e499912f210bbdac288a9", ("email", "phone")),
    LOCAL_PRINCIPAL,
)

# One expression for both engines: the value appended to each text.
INJECT = """CASE doc_id % 12
  WHEN 0 THEN concat(' mail user', doc_id, '@corp.example')
  WHEN 1 THEN concat(' tel 138', lpad(CAST(doc_id % 100000000 AS STRING), 8, '0'))
  WHEN 2 THEN concat(' id 11010519900307', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'))
  WHEN 3 THEN concat(' host 10.20.', doc_id % 250, '.', doc_id % 199)
  WHEN 4 THEN concat(' mac 00:1A:2B:3C:4D:', lpad(CAST(doc_id % 100 AS STRING), 2, '0'))
  WHEN 5 THEN concat(' imei 4901542032', lpad(CAST(doc_id % 100000 AS STRING), 5, '0'), ' end')
  WHEN 6 THEN concat(' vin 1HGCM82633A0', lpad(CAST(doc_id % 100000 AS STRING), 5, '0'))
  WHEN 7 THEN concat(' card 622202123456', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), ',')
  WHEN 8 THEN concat(' key sk-ABCDEFGH1234567890qrstuv', doc_id)
  WHEN 9 THEN concat(' auth Bearer abcdefgh.ijklmnop', doc_id, ' ok')
  WHEN 10 THEN concat(' 邮箱 user', doc_id, '@corp.example 电话 139', lpad(CAST(doc_id % 100000000 AS STRING), 8, '0'))
  ELSE concat(' tok ', md5(CAST(doc_id AS STRING))) END"""


def lit(text) -> str:
    if text is None:
        return "NULL"
    if isinstance(text, bool) or isinstance(text, (int, float)):
        return str(text)
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: tuple[str, ...], rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if not isinstance(v, tuple) else "[" + ", ".join(map(lit, v)) + "]" for v in row) + ")"
                     for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({', '.join(columns)})"


def case(column: str, table: dict) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


ACTION_RANK = {"allow": 0, "redact": 1, "review": 2, "block": 3}
CLEARANCE_RANK = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}


def action_of(rank: str) -> str:
    return f"(['allow','redact','review','block'])[({rank}) + 1]"


def entropy(column: str) -> str:
    """Bits per byte of an ASCII token."""
    return (
        f"list_sum(list_transform(list_distinct(string_split({column}, '')), lambda c: "
        f"-(len(list_filter(string_split({column}, ''), lambda d: d = c)) / length({column})::DOUBLE) "
        f"* log2(len(list_filter(string_split({column}, ''), lambda d: d = c)) / length({column})::DOUBLE)))"
    )


RUN = r"[A-Za-z0-9\-_./+=]{20,}"


def rule_spans(table: str, key: str, pattern: str, rule: int, group: int, text: str = "text") -> str:
    """Spans of one rule: matches, and the text between them cut out by replacing every match."""
    p = lit(pattern)
    return f"""SELECT {key}, {rule} AS rule, i,
      list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
        + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x)))::BIGINT, 0)
        + strpos(whole[i], found[i]) - 1 AS start_, found[i] AS matched, text
    FROM (SELECT {key}, {text} AS text, whole, found, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT {key}, {text}, regexp_extract_all({text}, {p}, 0) AS whole, regexp_extract_all({text}, {p}, {group}) AS found,
             string_split(regexp_replace({text}, {p}, chr(1), 'g'), chr(1)) AS gaps
      FROM {table} WHERE regexp_matches({text}, {p})))"""


def findings_sql(table: str, key: str, text: str = "text") -> str:
    parts = [
        rule_spans(table, key, r.pattern, n, 1 if re.compile(r.pattern).groups else 0, text) for n, r in enumerate(DEFAULT_RULES)
    ]
    n = len(DEFAULT_RULES)
    parts.append(f"SELECT * FROM ({rule_spans(table, key, RUN, n, 0, text)}) WHERE {entropy('matched')} >= {DEFAULT_ENTROPY.min_entropy}")
    union = " UNION ALL ".join(parts)
    return f"""SELECT f.{key}, (row_number() OVER (PARTITION BY f.{key} ORDER BY f.rule, f.i) - 1)::INT AS ord, r.*,
      f.start_, f.start_ + length(f.matched) AS end_, strlen(substring(f.text, 1, f.start_::INT)) AS byte_start,
      strlen(substring(f.text, 1, f.start_::INT)) + strlen(f.matched) AS byte_end,
      f.matched, sha256(f.matched) AS matched_sha256, strlen(f.matched) AS matched_len
    FROM ({union}) f JOIN rules r ON r.rule = f.rule"""


MASK = """CASE masking WHEN 'placeholder' THEN '[' || upper(label) || ']'
  WHEN 'partial_email' THEN CASE WHEN strpos(matched, '@') = 0 THEN '[EMAIL]'
    ELSE (CASE WHEN strpos(matched, '@') = 1 THEN '*' ELSE substring(matched, 1, 1) END) || '***@' || substring(matched, strpos(matched, '@') + 1) END
  WHEN 'partial_phone' THEN CASE WHEN strlen(matched) < 7 THEN '[PHONE]' ELSE left(matched, 3) || '****' || right(matched, 4) END
  WHEN 'keep_last4' THEN CASE WHEN strlen(matched) <= 4 THEN '[ID]' ELSE '************' || right(matched, 4) END
  WHEN 'hash' THEN '[' || upper(label) || ':' || substring(sha256(matched), 1, 12) || ']'
  WHEN 'full' THEN '[REDACTED]' END"""


def redacted_sql(resolved: str, table: str, key: str, text: str = "text") -> str:
    """Rows of ``table`` with the rewritten text, from one row per resolved finding."""
    return f"""SELECT t.{key}, CASE WHEN s.spans IS NULL THEN t.{text} ELSE
        list_reduce(s.spans, lambda acc, x: CASE WHEN x.a < acc.until THEN acc ELSE
          {{'until': x.b, 'res': acc.res || substring(t.{text}, acc.until::INT + 1, (x.a - acc.until)::INT) || x.m}} END,
          {{'until': 0::BIGINT, 'res': ''}}).res
        || substring(t.{text}, list_reduce(s.spans, lambda acc, x: CASE WHEN x.a < acc.until THEN acc ELSE
          {{'until': x.b, 'res': ''}} END, {{'until': 0::BIGINT, 'res': ''}}).until::INT + 1) END AS redacted
      FROM {table} t LEFT JOIN (
        SELECT {key}, list({{'a': start_::BIGINT, 'b': end_::BIGINT, 'm': {MASK}}}
          ORDER BY start_, end_ - start_ DESC, {case('effective_action', ACTION_RANK)} DESC, ord) AS spans
        FROM {resolved} WHERE effective_action <> 'allow' GROUP BY {key}) s ON s.{key} = t.{key}"""


RULE_COLUMNS = ("rule", "rule_name", "label", "severity", "authorized_action", "unauthorized_action", "min_clearance", "masking")
RULE_ROWS = [
    (n, r.name, r.label, r.severity, r.authorized_action, r.unauthorized_action, r.min_clearance, r.masking)
    for n, r in enumerate((*DEFAULT_RULES, DEFAULT_ENTROPY))
]

AUTHORISED = f"""CASE WHEN {case('p.clearance', CLEARANCE_RANK)} >= {case('f.min_clearance', CLEARANCE_RANK)}
  AND list_contains(p.allowed_labels, f.label) THEN f.authorized_action ELSE f.unauthorized_action END"""

VIEWS = {
    "scan_docs": f"SELECT doc_id, source, lang, concat(text, {INJECT}) AS text FROM documents",
    "rules": values("rules", RULE_COLUMNS, RULE_ROWS),
    "callers": values(
        "callers", ("who", "principal", "tenant_id", "role", "clearance", "secret_sha256", "allowed_labels"),
        [(n, p.name, p.tenant_id, p.role, p.clearance, p.secret_sha256, p.allowed_labels) for n, p in enumerate(CALLERS)],
    ).replace("[])", "CAST([] AS VARCHAR[]))"),
    "traffic": """SELECT doc_id, concat('req-', doc_id) AS request_id, 1704067200 + doc_id AS ts, doc_id % 4 AS who,
      concat('sess-', doc_id % 23) AS session_id, CASE WHEN doc_id % 2 = 0 THEN 'request' ELSE 'response' END AS direction,
      CASE doc_id % 3 WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/embeddings' ELSE '/v1/responses' END AS path, text
      FROM scan_docs""",
    "findings": findings_sql("scan_docs", "doc_id"),
    "resolved": f"""SELECT f.*, t.direction, t.request_id, t.who, {AUTHORISED} AS action,
      CASE WHEN t.direction = 'response' AND {AUTHORISED} <> 'allow' THEN 'redact' ELSE {AUTHORISED} END AS effective_action
      FROM findings f JOIN traffic t ON t.doc_id = f.doc_id JOIN callers p ON p.who = t.who""",
    "decisions": f"""SELECT t.*, coalesce(r.top, 0) AS base_rank, {action_of('coalesce(r.top, 0)')} AS base_decision, coalesce(r.n, 0) AS n
      FROM traffic t LEFT JOIN (SELECT doc_id, max({case('action', ACTION_RANK)}) AS top, count(*) AS n FROM resolved GROUP BY doc_id) r
      ON r.doc_id = t.doc_id""",
    "sanitised": redacted_sql("resolved", "traffic", "doc_id"),
}


def with_views(sql: str) -> str:
    """Put the views a text mentions (and those they mention) in front of it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(body)
                if name not in needed:
                    needed.append(name)

    add(sql)
    if not needed:
        return sql
    front = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {front}, {sql.lstrip()[5:]}"
    return f"WITH {front} {sql}"
