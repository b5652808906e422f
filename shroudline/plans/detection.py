"""Detection and masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.config import DEFAULT_RULES, Detection, EntityRule, Rule
from shroudline.functions import masks, ranks, regex, text as T, tokens
from shroudline.operators import detect as D, policy as P, redact as R, skew
from shroudline.plans import sql as S, views as V
from shroudline.plans.registry import query

RULE = {rule.name: rule for rule in DEFAULT_RULES}
PHONE, EMAIL = RULE["phone_cn"].pattern, RULE["email"].pattern

ENTITIES = (
    EntityRule("PERSON", "person", "medium", "redact", "redact", "internal", "placeholder", 0.35),
    EntityRule("LOCATION", "location", "low", "allow", "redact", "internal", "placeholder", 0.5),
)


def exploded(spark, d):
    return D.explode_findings(V.found(spark, d), "doc_id")


# The rule table is joined with what each rule found, so the answer covers the texts and not the
# configuration alone.
@query("rules_table", """SELECT r.rule_name, r.label, r.severity, r.authorized_action, r.unauthorized_action, r.min_clearance, r.masking,
  count(f.doc_id) AS n_findings FROM rules r LEFT JOIN findings f ON f.rule = r.rule GROUP BY ALL""")
def rules_table(spark, d):
    from shroudline.sources.rules import rules_df

    counts = exploded(spark, d).groupBy("rule_name").agg(F.count("*").alias("n_findings"))
    rules = rules_df(spark, V.CONFIG).drop("pattern", "ord")
    return rules.join(counts, "rule_name", "left").fillna(0, ["n_findings"])


@query("regex_findings", """SELECT doc_id, rule_name, matched, count(*) AS n FROM findings WHERE rule < 10 GROUP BY ALL""")
def regex_findings(spark, d):
    config = Detection(high_entropy=None)
    found = D.detect(V.scan_docs(spark, d), config, pointer=F.lit("/"))
    return D.explode_findings(found, "doc_id").groupBy("doc_id", "rule_name", "matched").agg(F.count("*").alias("n"))


# Rules as users write them: brackets inside classes, a leading bracket, named classes, counts and anchors.
USER_RULES = (
    (r"[[(]\s*(\d{2,6})", r"[\[(][\t-\r\x1c-\x20]*([0-9]{2,6})", 1), (r"[^[]\s+(of|des|les)[ ,.]", r"[^\[][\t-\r ]+(of|des|les)[ ,.]", 1), (r"[]|][^]\s]*", r"[\]|][^\]\t-\r ]*", 0),
    (r"[[:upper:]][[:digit:]]+", r"[A-Z][0-9]+", 0), (r"[%&*]{3}[^&~]", r"[%&*]{3}[^&~]", 0), (r"a{1,1500}n", r"a{1,1000}n", 0), (r"[\w.]+$", r"[\pL\pM\pN_.]+$", 0),
)


@query("user_rules", " UNION ALL ".join(
    f"SELECT doc_id, 'u{i}' AS rule_name, matched, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {S.lit(sql)}, {group})) AS matched FROM rule_docs) GROUP BY ALL"
    for i, (_, sql, group) in enumerate(USER_RULES)).join(("WITH rule_docs AS (SELECT doc_id, text || ' [ 12345 (99 |x]y' AS text FROM scan_docs) ", "")))
def user_rules(spark, d):
    config = Detection(rules=tuple(Rule(f"u{i}", "user", pattern) for i, (pattern, _, _) in enumerate(USER_RULES)), high_entropy=None)
    docs = V.scan_docs(spark, d).withColumn("text", F.concat("text", F.lit(" [ 12345 (99 |x]y")))
    return D.explode_findings(D.detect(docs, config, pointer=F.lit("/")), "doc_id").groupBy("doc_id", "rule_name", "matched").agg(F.count("*").alias("n"))


@query("regex_group_span", f"""SELECT doc_id, array_to_string(regexp_extract_all(text, {S.lit(PHONE)}, 1), ',') AS captured,
  array_to_string(regexp_extract_all(text, {S.lit(PHONE)}, 0), ',') AS whole FROM scan_docs""")
def regex_group_span(spark, d):
    java = F.lit(regex.to_java(PHONE))
    return V.scan_docs(spark, d).select(
        "doc_id",
        V.joined(F.regexp_extract_all("text", java, F.lit(1))).alias("captured"),
        V.joined(F.regexp_extract_all("text", java, F.lit(0))).alias("whole"),
    )


@query("finding_spans", """SELECT doc_id, ord, rule_name, start_::BIGINT AS span_start, end_::BIGINT AS span_end,
  byte_start::BIGINT AS byte_start, byte_end::BIGINT AS byte_end, matched FROM findings""")
def finding_spans(spark, d):
    return exploded(spark, d).select(
        "doc_id", "ord", "rule_name", F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"),
        F.col("byte_start").cast("bigint").alias("byte_start"), F.col("byte_end").cast("bigint").alias("byte_end"), "matched",
    )


# The column-expression form of span detection, kept as an independent second way.
@query("finding_spans_native", """SELECT doc_id, rule_name, start_::BIGINT AS span_start, end_::BIGINT AS span_end, matched
  FROM findings WHERE rule IN (0, 1, 3)""")
def finding_spans_native(spark, d):
    def named(name):
        return F.transform(T.spans_of(F.col("text"), RULE[name].pattern), lambda s: F.struct(F.lit(name).alias("rule_name"), s.alias("s")))

    parts = [named(name) for name in ("email", "phone_cn", "ip_address")]
    spans = V.scan_docs(spark, d).select("doc_id", F.explode(F.concat(*parts)).alias("x"))
    return spans.select(
        "doc_id", "x.rule_name", F.col("x.s.start").cast("bigint").alias("span_start"),
        F.col("x.s.end").cast("bigint").alias("span_end"), "x.s.matched",
    )


@query("regex_prefilter", f"""SELECT doc_id, concat_ws(',', {', '.join(
    f"CASE WHEN regexp_matches(text, {S.lit(r.pattern)}) THEN {S.lit(r.name)} END" for r in DEFAULT_RULES)}) AS rules FROM scan_docs""")
def regex_prefilter(spark, d):
    return V.scan_docs(spark, d).select("doc_id", V.joined(D.prefilter(F.col("text"), V.CONFIG)).alias("rules"))


@query("entropy_tokens", f"""SELECT doc_id, token, round({S.entropy('token')}, 6) AS bits FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, {S.lit(S.RUN)})) AS token FROM scan_docs) WHERE {S.entropy('token')} >= 3.6""")
def entropy_tokens(spark, d):
    found = V.scan_docs(spark, d).select("doc_id", F.explode(T.entropy_tokens(F.col("text"), 20, 3.6)).alias("token"))
    return found.select("doc_id", "token", F.round(T.shannon_entropy(F.col("token")), 6).alias("bits"))


@query("shannon_entropy", f"""SELECT page_id, round({S.entropy('url')}, 6) AS bits FROM pages""")
def shannon_entropy(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.round(T.shannon_entropy(F.col("url")), 6).alias("bits"))


@query("finding_hash", """SELECT doc_id, ord, matched_sha256, matched_len::BIGINT AS matched_len FROM findings""")
def finding_hash(spark, d):
    return exploded(spark, d).select("doc_id", "ord", "matched_sha256", F.col("matched_len").cast("bigint").alias("matched_len"))


# Two annotations per text, of a mapped and of a sometimes unmapped type, some past the end.
NER_SQL = """annotations AS (
  SELECT doc_id, 0 AS a, 'PERSON' AS entity_type, (doc_id % 7)::INT AS s, (doc_id % 7 + doc_id % 5)::INT AS e, (doc_id % 10) / 10.0 AS score FROM scan_docs
  UNION ALL
  SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN 'ORG' ELSE 'LOCATION' END, (length(text) - doc_id % 4)::INT, (length(text) + 5)::INT, (doc_id % 8) / 8.0 FROM scan_docs),
ner AS (SELECT t.doc_id, least(s, length(text))::INT AS s, least(e, length(text))::INT AS e, text, score,
    CASE entity_type WHEN 'PERSON' THEN 'presidio:PERSON' ELSE 'presidio:LOCATION' END AS rule_name,
    CASE entity_type WHEN 'PERSON' THEN 'person' ELSE 'location' END AS label
  FROM annotations a JOIN scan_docs t ON t.doc_id = a.doc_id
  WHERE entity_type <> 'ORG' AND score >= CASE entity_type WHEN 'PERSON' THEN 0.35 ELSE 0.5 END
    AND least(s, length(text)) < least(e, length(text)) AND trim(text) <> '')"""


def annotations(docs):
    doc, size = F.col("doc_id"), F.char_length("text")
    first = F.struct(F.lit("PERSON").alias("entity_type"), (doc % 7).cast("int").alias("start"),
                     (doc % 7 + doc % 5).cast("int").alias("end"), ((doc % 10) / 10.0).alias("score"))
    second = F.struct(F.when(doc % 3 == 0, "ORG").otherwise("LOCATION").alias("entity_type"), (size - doc % 4).cast("int").alias("start"),
                      (size + 5).cast("int").alias("end"), ((doc % 8) / 8.0).alias("score"))
    rows = docs.select("doc_id", F.lit("/").alias("pointer"), F.explode(F.array(first, second)).alias("a"))
    return rows.select("doc_id", "pointer", "a.*")


def with_ner(spark, d):
    config = Detection(entities=ENTITIES)
    docs = V.scan_docs(spark, d).withColumn("pointer", F.lit("/"))
    return config, D.ner_findings(docs, annotations(docs), config, keys=("doc_id", "pointer"))


@query("ner_merge", f"""WITH {NER_SQL} SELECT doc_id, rule_name, label, s::BIGINT AS span_start, e::BIGINT AS span_end,
  substring(text, s + 1, e - s) AS matched, strlen(substring(text, 1, s))::BIGINT AS byte_start FROM ner""")
def ner_merge(spark, d):
    _, leaves = with_ner(spark, d)
    return leaves.select("doc_id", F.explode("ner").alias("f")).select(
        "doc_id", "f.rule_name", "f.label", F.col("f.start").cast("bigint").alias("span_start"),
        F.col("f.end").cast("bigint").alias("span_end"), "f.matched", F.col("f.byte_start").cast("bigint").alias("byte_start"),
    )


@query("all_findings", f"""WITH {NER_SQL}, numbered AS (
  SELECT doc_id, ord::BIGINT AS ord, rule_name FROM findings UNION ALL
  SELECT n.doc_id, coalesce(c.n, 0) + row_number() OVER (PARTITION BY n.doc_id ORDER BY s, e, rule_name) - 1, rule_name
  FROM ner n LEFT JOIN (SELECT doc_id, count(*) AS n FROM findings GROUP BY doc_id) c ON c.doc_id = n.doc_id)
  SELECT doc_id, string_agg(rule_name, ',' ORDER BY ord) AS rules, count(*) AS n FROM numbered GROUP BY doc_id""")
def all_findings(spark, d):
    config, leaves = with_ner(spark, d)
    rows = D.detect(leaves, config, ner=F.col("ner")).where(F.size("findings") > 0)
    names = F.transform(F.array_sort(F.transform("findings", lambda f: F.struct(f["ord"].alias("o"), f["rule_name"].alias("r")))), lambda x: x["r"])
    return rows.select("doc_id", V.joined(names).alias("rules"), F.size("findings").cast("bigint").alias("n"))


@query("char_to_byte", """SELECT doc_id, strlen(substring(text, 1, least(doc_id % 500, length(text))::INT))::BIGINT AS byte_offset,
  strlen(substring(text, 1, least(doc_id * 1000, length(text))::INT))::BIGINT AS clamped FROM scan_docs""")
def char_to_byte(spark, d):
    text, doc = F.col("text"), F.col("doc_id")
    return V.scan_docs(spark, d).select(
        "doc_id", T.char_to_byte(text, doc % 500).cast("bigint").alias("byte_offset"), T.char_to_byte(text, doc * 1000).cast("bigint").alias("clamped")
    )


@query("rule_matrix_counts", """SELECT rule_name, label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM findings GROUP BY ALL""")
def rule_matrix_counts(spark, d):
    per_doc = exploded(spark, d).groupBy("rule_name", "label", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("rule_name", "label").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query("findings_by_label", """SELECT t.source, f.label, count(*) AS n FROM findings f JOIN scan_docs t ON t.doc_id = f.doc_id GROUP BY ALL""")
def findings_by_label(spark, d):
    found = D.detect(V.scan_docs(spark, d), V.CONFIG, pointer=F.lit("/"))
    return D.explode_findings(found, "source").groupBy("source", "label").agg(F.count("*").alias("n"))


@query("overlap_greedy", """WITH kept AS (
  SELECT doc_id, list_reduce(spans, lambda acc, x: CASE WHEN x.a < acc.until THEN acc ELSE
      {'until': x.b, 'kept': list_concat(acc.kept, [x.r])} END, {'until': 0::BIGINT, 'kept': CAST([] AS VARCHAR[])}).kept AS kept
  FROM (SELECT doc_id, list({'a': byte_start::BIGINT, 'b': byte_end::BIGINT, 'r': rule_name} ORDER BY byte_start, byte_end - byte_start DESC,
      CASE effective_action WHEN 'block' THEN 3 WHEN 'review' THEN 2 WHEN 'redact' THEN 1 ELSE 0 END DESC, ord) AS spans
    FROM resolved WHERE effective_action <> 'allow' GROUP BY doc_id))
  SELECT t.doc_id, coalesce(array_to_string(k.kept, ','), '') AS kept FROM traffic t LEFT JOIN kept k ON k.doc_id = t.doc_id""")
def overlap_greedy(spark, d):
    rows = V.outcomes(spark, d)
    kept = F.transform(R.resolve_overlaps(F.col("resolved")), lambda f: f["rule_name"])
    return rows.select("doc_id", V.joined(kept).alias("kept"))


@query("redact_text", """SELECT doc_id, redacted FROM sanitised""")
def redact_text(spark, d):
    return V.judged(spark, d).select("doc_id", "redacted")


SCRUB_VIEWS = f"""raw_findings AS ({S.findings_sql('documents', 'doc_id')}),
  raw_resolved AS (SELECT *, unauthorized_action AS effective_action FROM raw_findings),
  raw_redacted AS ({S.redacted_sql('raw_resolved', 'documents', 'doc_id')})"""


@query("scrub_documents", f"""WITH {SCRUB_VIEWS}
  SELECT r.doc_id, r.redacted, {S.action_of('coalesce(f.top, 0)')} AS decision, coalesce(f.labels, '') AS labels
  FROM raw_redacted r LEFT JOIN (SELECT doc_id, max({S.case('unauthorized_action', S.ACTION_RANK)}) AS top,
    string_agg(label, ',' ORDER BY ord) AS labels FROM raw_findings GROUP BY doc_id) f ON f.doc_id = r.doc_id""")
def scrub_documents(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return R.scrub(docs, V.CONFIG).select(
        "doc_id", "redacted", "decision", V.joined(F.transform("resolved", lambda f: f["label"])).alias("labels")
    )


@query("scrub_pages", f"""WITH page_findings AS ({S.findings_sql('pages', 'page_id', 'html')}),
  page_resolved AS (SELECT *, unauthorized_action AS effective_action FROM page_findings),
  page_redacted AS ({S.redacted_sql('page_resolved', 'pages', 'page_id', 'html')})
  SELECT page_id, redacted FROM page_redacted""")
def scrub_pages(spark, d):
    pages = V.table(spark, d, "pages").select("page_id", "html")
    return R.scrub(pages, V.CONFIG, "html").select("page_id", "redacted")


def mask_query(strategy: str, mask):
    masked = S.MASK.replace("CASE masking", f"CASE '{strategy}'", 1)

    @query(f"mask_{ {'partial_email': 'email', 'partial_phone': 'phone', 'keep_last4': 'last4'}.get(strategy, strategy) }",
           f"SELECT doc_id, ord, {masked} AS masked FROM findings")
    def run(spark, d):
        return exploded(spark, d).select("doc_id", "ord", mask(F.col("matched"), F.col("label")).alias("masked"))


for _strategy, _mask in masks.MASKS.items():
    mask_query(_strategy, _mask)

# A fixed key for checking only; jobs read theirs from the environment.
CHECK_KEY = bytes(range(32))


@query("tokenize_roundtrip", """SELECT doc_id, ord, label, matched AS opened, true AS well_formed FROM findings""")
def tokenize_roundtrip(spark, d):
    seal = tokens.tokenizer(CHECK_KEY, "tok1")
    sealed = exploded(spark, d).select("doc_id", "ord", "label", F.array(seal(F.col("label"), F.col("matched"))).alias("t"))
    # the token is bound once (explode) because a second evaluation would draw another nonce
    bound = sealed.select("doc_id", "ord", "label", F.explode("t").alias("token"))
    bound = bound.withColumn("opened", skew.bound(tokens.detokenize(F.col("token"), CHECK_KEY, "tok1")))
    opened = F.col("opened")
    shape = F.concat(F.lit(r"^\["), F.upper("label"), F.lit(r"_TOKEN:tok1\.[A-Za-z0-9_-]{16},[A-Za-z0-9_-]+\]$"))
    return bound.select("doc_id", "ord", opened["label"].alias("label"), opened["value"].alias("opened"), F.rlike("token", shape).alias("well_formed"))


@query("detokenize", """SELECT doc_id, ord, CASE WHEN doc_id % 3 = 0 THEN matched WHEN doc_id % 3 = 1 THEN matched END AS opened FROM findings""")
def detokenize(spark, d):
    """Bracketed and bare tokens open; a foreign prefix gives NULL."""
    seal = tokens.tokenizer(CHECK_KEY, "tok1")
    sealed = exploded(spark, d).select("doc_id", "ord", F.explode(F.array(seal(F.col("label"), F.col("matched")))).alias("token"))
    bare = F.regexp_extract("token", r"^\[[^:]*:(.*)\]$", 1)
    given = F.when(F.col("doc_id") % 3 == 0, F.col("token")).when(F.col("doc_id") % 3 == 1, bare).otherwise(F.replace("token", F.lit("tok1."), F.lit("tok2.")))
    return sealed.select("doc_id", "ord", tokens.detokenize(given, CHECK_KEY, "tok1")["value"].alias("opened"))


@query("redact_tokenized", """SELECT t.doc_id, t.text AS restored, coalesce(f.n, 0) AS n_tokens FROM scan_docs t
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM findings WHERE rule = 0 GROUP BY doc_id) f ON f.doc_id = t.doc_id""")
def redact_tokenized(spark, d):
    """Texts whose e-mail addresses became tokens, restored again by opening them."""
    rule = DEFAULT_RULES[0]
    config = Detection(rules=(type(rule)(**{**rule.__dict__, "masking": "tokenize"}),), high_entropy=None)
    docs = R.scrub(V.scan_docs(spark, d), config, tokenizer=tokens.tokenizer(CHECK_KEY, "tok1")).select("doc_id", F.explode(F.array("redacted")).alias("t"))
    found = F.regexp_extract_all("t", F.lit(r"\[EMAIL_TOKEN:[^\]]*\]"), F.lit(0))
    back = F.aggregate(found, F.col("t"), lambda acc, token: F.replace(acc, token, tokens.detokenize(token, CHECK_KEY, "tok1")["value"]))
    return docs.select("doc_id", back.alias("restored"), F.size(found).cast("bigint").alias("n_tokens"))


@query("replace_longest_first", """SELECT doc_id, replace(replace(replace(text, concat(substring(text, 1, 6)), 'LONG'),
  substring(text, 1, 3), 'MID'), 'e', 'E') AS replaced FROM scan_docs WHERE true""")
def replace_longest_first(spark, d):
    text = F.col("text")
    entries = F.array(
        F.struct(F.lit("e").alias("key"), F.lit("E").alias("value")),
        F.struct(F.concat(F.substring(text, 1, 3)).alias("key"), F.lit("MID").alias("value")),
        F.struct(F.substring(text, 1, 6).alias("key"), F.lit("LONG").alias("value")),
    )
    return V.scan_docs(spark, d).select("doc_id", R.replace_longest_first(text, F.map_from_entries(entries)).alias("replaced"))


@query("local_principal", f"""SELECT f.doc_id, max({S.case('f.unauthorized_action', S.ACTION_RANK)}) AS strictest FROM findings f GROUP BY f.doc_id""")
def local_principal(spark, d):
    resolved = P.resolve(F.col("findings"), P.local_principal(), F.lit("request"))
    rows = V.found(spark, d).where(F.size("findings") > 0)
    return rows.select("doc_id", ranks.action_rank(P.decide(resolved)).alias("strictest"))
