"""The queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.llm import contamination, exact, lines, near, packing, pages, quality, repair, secrets, shards, token_files, toxicity, trie, work
from shroudline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_content_sort", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(table(spark, sf_dir, "documents"))


@query("op4_line_dedup", """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_shards")
def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op9_token_files")
def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work.work_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_near_dedup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], chr(10)) AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
""")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.find_near(table(spark, sf_dir, "documents"), width=4)


def secret_spans(rank: int, kind: str) -> str:
    """Spans of one kind: matches and the text between them, lengths added up."""
    pattern, group, least = secrets.KINDS[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    mixed = "AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')" if kind == "key" else ""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start_, s + length(m) AS end_ FROM (
      SELECT doc_id, whole[i] AS m, part[i] AS v, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0))::BIGINT AS s FROM (
        SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, {p}, 0) AS whole, regexp_extract_all(text, {p}, {group}) AS part, string_split_regex(text, {p}) AS gaps
          FROM documents WHERE regexp_matches(text, {p})))) WHERE length(v) >= {least} {mixed}"""


@query("op1_secrets", f"""
WITH found AS ({' UNION ALL '.join(secret_spans(i, k) for i, k in enumerate(secrets.KINDS))}),
met AS (
  SELECT w.doc_id, w.rank, w.start_, w.end_, bool_or(o.kind IN ('access', 'ident')) AS named, bool_or(o.kind IN ('assign', 'hex', 'key')) AS keyed
  FROM found w JOIN found o ON o.doc_id = w.doc_id AND abs(o.start_ - w.start_) <= 200 AND (o.start_ >= w.end_ OR o.end_ <= w.start_) AND o.kind <> 'endpoint'
  WHERE w.rank > 2 GROUP BY ALL
), spans AS (
  SELECT f.* FROM found f LEFT JOIN met m ON m.doc_id = f.doc_id AND m.rank = f.rank AND m.start_ = f.start_
  WHERE f.rank < 3 OR (f.kind = 'key' AND m.named) OR (f.kind = 'ident' AND m.keyed) OR (f.kind = 'endpoint' AND m.named AND m.keyed)
), texts AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
    string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) AS all_
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(all_, '') AS spans
FROM documents d LEFT JOIN texts t USING (doc_id)
""")
def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontamination", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(13, len(w)) AS m
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, m, item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM places) JOIN win USING (win, m)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Keyed turns of every conversation after its rebuilding: the first h turns of its base, then its own after its first h."""
    start = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    every = turns.filter("position = 0").select("conv_id", start.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = turns.filter("position < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    taken = every.join(heads, "base").filter("position < h").select(*turns.columns)
    own = turns.filter(F.col("position") >= start)
    bare = every.select("conv_id", F.lit(-1).cast("long").alias("position"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("size"))
    return taken.unionByName(own).unionByName(bare)


@query("op12_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# crc32 of an ASCII string, byte by byte; CRC_TABLE has the 256 steps.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


@query("op11_prefix_trie", f"""
WITH crc AS ({CRC_TABLE}),
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''),
  md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, w, conv_id - conv_id % 5 AS base, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM own, crc),
new AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN own b ON b.conv_id = h.base),
pre AS (SELECT conv_id, w[1:d] AS p, d, d = len(w) AS ends FROM (SELECT *, unnest(range(len(w) + 1)) AS d FROM new)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
sub AS (SELECT p[1:k] AS p, k AS d, count(*) FILTER (WHERE leaf) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].text) ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM nodes) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sub ON sub.p = n.p AND sub.d = n.d LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d
LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1] AND n.d > 0
""")
def prefix_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = work.settle(trie.keyed_turns(table(spark, sf_dir, "conversations")), "turns")
    return trie.trie_of(rebuilt(turns))


def edit(state: str, cost: str, letter: str) -> str:
    """One more edit behind a label: nine digits of cost, then the audit; null stays null."""
    return f"lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}'"


def after_row(first: str, states: tuple[str, str, str, str]) -> str:
    """Labels of the four states after a row: start, system, user, assistant; n0 to n3 before inserts, s0 to s3 with them."""
    s0, s1, s2, s3 = states
    keep = {1: ("'s'", (s0,)), 2: ("'u'", (s0, s1, s3)), 3: ("'a'", (s2,))}
    out = []
    for q, own in enumerate(states):
        ways = [edit(own, "3", "D")]
        if q:
            initial, before = keep[q]
            ways += [f"CASE WHEN NOT gone AND {first} = {initial} THEN {edit(b, 't', 'K')} END" for b in before]
            if q > 1:
                ways += [f"CASE WHEN NOT gone THEN {edit(b, '2 + t', 'R')} END" for b in before]
        out.append(f"least({', '.join(ways)}, NULL) AS n{q}")
    return ", ".join(out)


INSERTS = f"""n0 AS s0, n1 AS s1, least(n2, {', '.join(edit(b, '2', 'I') for b in ('n0', 'n1', 'n3'))}) AS s2,
  least(n3, {edit('n2', '2', 'I')}, {', '.join(edit(edit_once, '2', 'I') for edit_once in (f"({edit(b, '2', 'I')})" for b in ('n0', 'n1')))}) AS s3"""
STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op13_structure_repair", f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS code
  FROM conversations, crc WHERE conv_id IS NOT NULL),
bad AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE code <> 0),
r AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  left(role, 1) AS first, lag(left(role, 1)) OVER w AS before FROM bad WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN {STRIPPED} = '' THEN 'b' WHEN again THEN 'd' WHEN right({STRIPPED}, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault FROM r),
g AS (SELECT conv_id, i, first, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS t FROM f),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {INSERTS} FROM (SELECT DISTINCT conv_id, '000000000' AS n0, NULL::VARCHAR AS n1, NULL::VARCHAR AS n2, NULL::VARCHAR AS n3 FROM c)
  UNION ALL
  SELECT conv_id, i, {INSERTS} FROM (SELECT g.conv_id, g.i, {after_row("g.first", ("s0", "s1", "s2", "s3"))} FROM walk JOIN g ON g.conv_id = walk.conv_id AND g.i = walk.i + 1)
),
ends AS (SELECT conv_id, left(least(s0, s3), 9)::BIGINT AS cost, substr(least(s0, s3), 10) AS audit FROM walk LEFT JOIN counts USING (conv_id) WHERE i = coalesce(n, 0)),
letters AS (SELECT conv_id, j, audit[j] AS letter FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS j FROM ends)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
led AS (SELECT p.conv_id, bool_or(p.o = 1 AND p.letter = 'K' AND left(f.role, 1) = 's') AS system FROM placed p JOIN f USING (conv_id, i) GROUP BY ALL),
fixed AS (SELECT p.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (o - coalesce(system, FALSE)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j) AS repaired
  FROM placed p LEFT JOIN f USING (conv_id, i) LEFT JOIN led USING (conv_id) WHERE letter <> 'D' GROUP BY p.conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id) LEFT JOIN fixed USING (conv_id)
""")
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged, gone = repair.damage(table(spark, sf_dir, "conversations"))
    out = repair.repair(damaged, gone=F.col(gone))
    return out.select(*out.columns[:-1], F.sha2(repair.joined(), 256).alias("repaired_sha256"))
