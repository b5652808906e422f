import random

import pytest
from pyspark.sql import functions as F

from shroudline.config import Detection, DEFAULT_RULES, Rule
from shroudline.functions import masks, tokens
from shroudline.operators import redact as R

CONFIG = Detection()
KEY = bytes(range(32))


def scrub(spark, *texts, config=CONFIG, tokenizer=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.redacted for r in R.scrub(df, config, tokenizer=tokenizer).orderBy("i").collect()]


def test_masks_in_text(spark):
    out = scrub(spark, "email admin@example.com phone 13812341234", "contact leak@corp.example now", "hello world", "", None)
    assert out == ["email a***@example.com phone 138****1234", "contact l***@corp.example now", "hello world", "", None]


def test_masking_again_changes_nothing_more(spark):
    once = scrub(spark, "card 6222021234567890, ip 10.0.0.1 mac 00:1A:2B:3C:4D:5E tel 13812341234")
    assert scrub(spark, *once) == once


@pytest.mark.parametrize("name, value, expected", [
    ("partial_email", "@x.y", "****@x.y"), ("partial_email", "plain", "[EMAIL]"), ("partial_email", "é@x@y", "é***@x@y"),
    ("partial_phone", "123456", "[PHONE]"), ("partial_phone", "1234567", "123****4567"),
    ("keep_last4", "1234", "[ID]"), ("keep_last4", "12345", "************2345"), ("full", "x", "[REDACTED]"), ("placeholder", "x", "[LABEL]"),
    ("hash", "x", "[LABEL:2d711642b726]"),
])
def test_mask_values(spark, name, value, expected):
    assert spark.range(1).select(masks.MASKS[name](F.lit(value), F.lit("label"))).first()[0] == expected


def greedy(spans):
    """(start, end, rank, ord, label) kept in order, by the rule in words."""
    kept, until = [], 0
    for span in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[2], s[3])):
        if span[0] >= until:
            kept.append(span)
            until = span[1]
    return kept


def test_overlaps_equal_the_plain_rule(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdéfg漢h") for _ in range(40))
    rows, expected = [], {}
    actions = ["redact", "review", "block"]
    for case in range(60):
        spans = []
        for ord_ in range(rng.randint(0, 8)):
            start = rng.randint(0, 38)
            end = rng.randint(start + 1, min(40, start + 8))
            rank = rng.randint(0, 2)
            spans.append((start, end, rank, ord_))
        rows.append((case, text, [
            dict(ord=o, label=f"L{o}", masking="placeholder", matched=text[s:e], byte_start=len(text[:s].encode()), byte_end=len(text[:e].encode()), effective_action=actions[r])
            for s, e, r, o in spans] + [dict(ord=99, label="NO", masking="placeholder", matched="", byte_start=0, byte_end=40, effective_action="allow")]))
        out, at = [], 0
        for s, e, _, o in greedy(spans):
            out += [text[at:s], f"[L{o}]"]
            at = e
        expected[case] = "".join(out) + text[at:]
    kind = "array<struct<ord:int,label:string,masking:string,matched:string,byte_start:int,byte_end:int,effective_action:string>>"
    df = spark.createDataFrame(rows, f"i int, text string, resolved {kind}")
    assert {r.i: r.out for r in df.select("i", R.redact_text(F.col("text"), F.col("resolved")).alias("out")).collect()} == expected


def test_tokens_open_again(spark):
    rule = Rule(**{**DEFAULT_RULES[0].__dict__, "masking": "tokenize"})
    config = Detection(rules=(rule,), high_entropy=None)
    (masked,) = scrub(spark, 'say "hi" to ü@corp.example', config=config, tokenizer=tokens.tokenizer(KEY, "tok1"))
    assert masked == 'say "hi" to ü@corp.example'  # the rule takes ASCII addresses only
    (masked,) = scrub(spark, "mail a@corp.example now", config=config, tokenizer=tokens.tokenizer(KEY, "tok1"))
    token = masked[len("mail ") : -len(" now")]
    assert token.startswith("[EMAIL_TOKEN:tok1.")
    bare = token[token.index(":") + 1 : -1]
    other = bytes(range(1, 33))

    def opened(text, key=KEY, prefix="tok1"):
        got = spark.range(1).select(tokens.detokenize(F.lit(text), key, prefix).alias("d")).first().d
        return got and (got.label, got.value)

    assert opened(token) == opened(f"  {bare} ") == ("email", "a@corp.example")
    assert opened(token, prefix="tok2") is None and opened(token, key=other) is None
    assert opened("[EMAIL_TOKEN:tok1.short,xx]") is None and opened("nonsense") is None


def test_tokenize_without_a_key_stops(spark):
    rule = Rule(**{**DEFAULT_RULES[0].__dict__, "masking": "tokenize"})
    with pytest.raises(Exception, match="token key"):
        scrub(spark, "mail a@corp.example", config=Detection(rules=(rule,), high_entropy=None))


def test_key_and_prefix_checks():
    assert tokens.decode_key("00" * 32) == bytes(32)
    assert tokens.decode_key("AAAA" * 10 + "AAA") == bytes(32)
    for bad in ("zz", "AAAA"):
        with pytest.raises(ValueError):
            tokens.decode_key(bad)
    for bad in ("", "a.b", "a]"):
        with pytest.raises(ValueError):
            tokens.check_prefix(bad)


def test_longest_value_first(spark):
    replacements = F.create_map(F.lit("ab"), F.lit("1"), F.lit("abc"), F.lit("2"), F.lit("x"), F.lit("x"))
    assert spark.range(1).select(R.replace_longest_first(F.lit("abcab x"), replacements)).first()[0] == "21 x"
