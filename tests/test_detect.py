import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shroudline.config import DEFAULT_RULES, Detection, EntityRule, Rule, detection_from, principals_from
from shroudline.functions import regex, text as T
from shroudline.operators import detect as D, redact as R

CONFIG = Detection()
PATTERNS = tuple(r.pattern for r in DEFAULT_RULES)


def labels(text):
    names = [r.label for r in CONFIG.scored]
    return [names[s["rule"]] for s in D.scan_batch(pa.array([text]), PATTERNS, 20, 3.6).to_pylist()[0]]


@pytest.mark.parametrize("text, expected", [
    ("contact admin@example.com and sk-ABCDEFGH1234567890qrstuv", ["email", "api_key", "secret_like"]),
    ("服务器 10.20.30.40 网卡 00:1A:2B:3C:4D:5E IMEI 490154203237518 VIN 1HGCM82633A004352 卡号 6222021234567890",
     ["ip_address", "mac_address", "imei", "vin", "bank_card"]),
    ("", []),
    ("13800138000,13900139000", ["phone"]),
    ("tel 13800138000\n", ["phone"]),
    ("hello world", []),
])
def test_labels(text, expected):
    assert labels(text) == expected


def test_offsets_after_wide_characters():
    spans = D.scan_batch(pa.array(["我的手机号是13800138000", "😀 a@b.co"]), PATTERNS, 20, 3.6).to_pylist()
    assert [(s["start"], s["end"], s["byte_start"], s["byte_end"]) for s in spans[0]] == [(6, 17, 18, 29)]
    assert [(s["start"], s["byte_start"], s["matched"]) for s in spans[1]] == [(2, 5, "a@b.co")]


def test_digits_of_any_script_match_in_every_engine(spark):
    text = "电话 1380０138000 完"
    assert labels(text) == ["phone"]
    java = regex.to_java(DEFAULT_RULES[1].pattern)
    assert spark.range(1).select(F.lit(text).rlike(java)).first()[0]


def test_end_anchor_is_the_end_of_the_text(spark):
    assert regex.to_java(r"a[$]$") == r"a[$]\z"
    assert not spark.range(1).select(F.lit("ab\n").rlike(regex.to_java("ab$"))).first()[0]
    assert not regex.compiled("ab$").search("ab\n")


def test_unsupported_rules_are_refused():
    for pattern in (r"a(?=b)", r"(a)\1", r"(?<!a)b"):
        with pytest.raises(regex.UnsupportedPattern):
            Detection(rules=(Rule("x", "x", pattern),))
    with pytest.raises(ValueError):
        Detection(rules=(Rule("x", "x", "("),))
    with pytest.raises(ValueError):
        Detection(rules=(Rule("x", "x", "a", masking="none"),))


ALPHABET = st.sampled_from(list("a1@.-:XF3 sk,\n") + ["é", "😀", "１"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.text(ALPHABET, max_size=30),
    st.sampled_from(["13812341234", "a@b.example", "10.0.0.1", "00:1A:2B:3C:4D:5E", "490154203237518", "Bearer abcdefghijklmnop.q"]),
), max_size=6))
def test_scan_equals_plain_regex(parts):
    """The batch pre-filter never loses or moves a match."""
    text = " ".join(parts)
    expected = []
    for number, pattern in enumerate(PATTERNS):
        compiled = re.compile(regex.to_python(pattern))
        for match in compiled.finditer(text):
            group = 1 if compiled.groups else 0
            expected.append((number, match.start(group), match.end(group), match.group(group)))
    got = D.scan_batch(pa.array([text]), PATTERNS, None, 0.0).to_pylist()[0]
    assert [(s["rule"], s["start"], s["end"], s["matched"]) for s in got] == expected
    for span in got:
        assert text.encode()[span["byte_start"] : span["byte_end"]].decode() == span["matched"]


def test_rules_without_a_batch_test_still_run():
    patterns = (r"\bcode\b", r"x\d")
    assert regex.to_re2(patterns[0]) is None
    spans = D.scan_batch(pa.array(["a code x1", None, "decode"]), patterns, None, 0.0).to_pylist()
    assert [[s["matched"] for s in row] for row in spans] == [["code", "x1"], [], []]


def test_native_spans_agree(spark):
    texts = ["mail a@b.example, c@d.example", "x", "", "13812341234 13912341234", "é a@b.example\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for number in (0, 1):
        rows = df.select("text", T.spans_of(F.col("text"), PATTERNS[number]).alias("s")).collect()
        for row in rows:
            arrow = [s for s in D.scan_batch(pa.array([row.text]), PATTERNS, None, 0.0).to_pylist()[0] if s["rule"] == number]
            assert [(s.start, s.end, s.matched) for s in row.s] == [(s["start"], s["end"], s["matched"]) for s in arrow]


def test_native_values_agree(spark):
    text = "mail a@b.example tok 5f4dcc3b5aa765d61d8327deb882cf99 tel 13812341234"
    row = spark.range(1).select(D.extract_values(F.lit(text), CONFIG).alias("v")).first()
    arrow = D.scan_batch(pa.array([text]), PATTERNS, 20, 3.6).to_pylist()[0]
    assert [(v.rule, v.matched) for v in row.v] == [(s["rule"], s["matched"]) for s in arrow]


def test_outside_annotations(spark):
    config = Detection(rules=(), high_entropy=None, entities=(EntityRule("PERSON", "person", authorized_action="redact"),))
    leaves = spark.createDataFrame([
        ("r1", "/c", "John shared an update"), ("r2", "/c", "邮箱 admin@example.com"), ("r3", "/c", "   "),
    ], "request_id string, pointer string, text string")
    notes = spark.createDataFrame([
        ("r1", "/c", 0, 4, 0.91, "PERSON"), ("r1", "/c", 5, 9, 0.2, "PERSON"), ("r1", "/c", 999, 1000, 0.9, "PERSON"), ("r1", "/c", 0, 4, 0.9, "ORG"),
        ("r2", "/c", 3, 20, 0.9, "PERSON"), ("r3", "/c", 0, 2, 0.9, "PERSON"),
    ], "request_id string, pointer string, start int, end int, score double, entity_type string")
    found = D.detect(D.ner_findings(leaves, notes, config), config, ner=F.col("ner"))
    rows = {r.request_id: r for r in found.collect()}
    assert [(f.matched, f.rule_name, f.byte_start) for f in rows["r1"].findings] == [("John", "presidio:PERSON", 0)]
    assert [(f.matched, f.byte_start) for f in rows["r2"].findings] == [("admin@example.com", 7)]
    assert rows["r3"].findings == []
    masked = R.judge(found, F.expr("named_struct('name','x','tenant_id','x','role','x','clearance','public','allowed_labels',array('x'))"), F.lit("request"))
    assert {r.request_id: r.redacted for r in masked.collect()}["r1"] == "[PERSON] shared an update"


def test_configuration_documents():
    config = detection_from({"detection": {
        "ignore_json_pointers": ["/model"], "high_entropy": {"enabled": False, "label": "s"},
        "presidio": {"entities": [{"entity_type": "PERSON", "label": "person", "min_score": 0.5}]},
        "rules": [{"name": "n", "label": "l", "pattern": "x", "unauthorized_action": "block", "authorized_action": "allow", "masking": "full"}],
    }})
    assert config.high_entropy is None and config.rules[0].severity == "medium" and config.rules[0].min_clearance == "internal"
    assert config.ignore_json_pointers == ("/model",) and config.entities[0].min_score == 0.5
    people = principals_from({"auth": {"principals": [{"name": "a", "tenant_id": "t", "role": "r", "clearance": "public", "allowed_labels": ["email"]}]}})
    assert people[0].allowed_labels == ("email",)


CLASSES = ["[[(]", "[^[]", "[]a]", "[^]a]", "[[:alpha:]]", "[a&&b]", r"[\]x-]", "[~|]", r"[\d.]", r"[^\s]"]
PIECES = st.sampled_from([*CLASSES, "a", "b", r"\d", r"\s", r"\w", ".", r"\[", "(?:a|b)", "x"])
COUNTS = st.sampled_from(["", "", "", "?", "+", "{1,3}", "{2}"])
RULE_TEXTS = st.text(st.sampled_from(list("ab[]()x12 \n&|~-^é.")), max_size=30)


def plain(pattern):
    """The rule for Python's own engine, written out by hand for the named class."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        text = pattern.replace("[[:alpha:]]", "[A-Za-z]")
        return re.compile(text[:-1] + r"\Z" if text.endswith("$") else text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, COUNTS), min_size=1, max_size=5), st.booleans(), st.lists(RULE_TEXTS, min_size=1, max_size=6))
def test_prefilter_and_spans_equal_the_plain_engine(pieces, end, texts):
    pattern = "".join(p + c for p, c in pieces) + ("$" if end else "")
    want = [[(m.start(), m.end()) for m in plain(pattern).finditer(t)] for t in texts]
    got = D.scan_batch(pa.array(texts), (pattern,), None, 0.0).to_pylist()
    assert [[(s["start"], s["end"]) for s in spans] for spans in got] == want
    assert [bool(names) for names in D.prefilter_batch(pa.array(texts), (pattern,), ("r",)).to_pylist()] == [bool(w) for w in want]


@pytest.mark.parametrize("pattern, text, found", [
    (r"[[(]\s*(\d{6})", "x( 123456 ) and [123456", ["123456", "123456"]), (r"[^[]\s+secret", "a  secret", ["a  secret"]), (r"[[]foo$", "[foo\n", []),
    (r"a{1,1500}b", "aab", ["aab"]), (r"(?x) a  b", "ab", ["ab"]),
])
def test_rules_that_engines_read_differently(pattern, text, found):
    assert [s["matched"] for s in D.scan_batch(pa.array([text]), (pattern,), None, 0.0).to_pylist()[0]] == found


@pytest.mark.parametrize("pattern", [r"(a+)+c$", r"(?:a|aa)+$", r"(?:a*b?)*c", r"(?P<x>a)(?P=x)", r"(?:[a-z]+\s?)+!"])
def test_rules_of_exponential_time_are_refused(pattern):
    with pytest.raises(ValueError):
        Detection(rules=(Rule("x", "x", pattern),))


def test_unknown_keys_are_refused():
    with pytest.raises(ValueError):
        detection_from({"rules": [{"name": "x", "label": "x", "pattern": "a", "unauthorised_action": "block"}]})
