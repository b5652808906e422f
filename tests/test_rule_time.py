"""Rules that a backtracking engine could hang on are refused at load; those let through stay fast."""

import random
import re
import signal
import time

import pytest

from shroudline.config import DEFAULT_RULES, Detection, Rule
from shroudline.functions import regex

HANG = [
    r"(?:a?){28}a{28}", r"(?:a{1,30}){1,30}c", r"(?:[a-z]{1,40}){1,40}!", r"a*a*a*a*a*a*b", r"(a+)+b", r"(a|a)*b", r"(?:a|aa)*b", r"(x+x+)+y", r"(?:a*)*b",
    r"^(\d+)*$", r"(?:(?:ab)+c?)+d", r"(\w+\s?)*!", r"(?:\p{L}+)+!", r"[\p{L}a]*\p{L}*\p{Ll}*!", r".*.*=", r"\w+\d+!", r"(?i)(?:Ab|aB)*c",
]
FAST = [
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(?:[a-z]+,)*[a-z]+", r"a+b+c+", r"\s*,\s*", r"(?:foo|bar)+x", r"(?:a|ab)*c", r"\p{L}+\s+\p{L}+",
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}", r"-----BEGIN [A-Z ]+-----[\s\S]+?-----END [A-Z ]+-----", r"(?:ab{1,30}){1,30}", r"(?:\d{1,3}\.){3}\d{1,3}", r"[^=]+=[^;]+;",
]


@pytest.mark.parametrize("pattern", HANG)
def test_refused(pattern):
    with pytest.raises(regex.UnsupportedPattern):
        Detection(rules=(Rule("x", "x", pattern),))


@pytest.mark.parametrize("pattern", FAST + [rule.pattern for rule in DEFAULT_RULES])
def test_let_through(pattern):
    Detection(rules=(Rule("x", "x", pattern),))


def made(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.35:
        return r.choice(["a", "b", "[ab]", "c", "[^a]", "ab", "."])
    if kind < 0.6:
        return made(r, depth + 1) + made(r, depth + 1)
    if kind < 0.75:
        return f"(?:{made(r, depth + 1)}|{made(r, depth + 1)})"
    return f"(?:{made(r, depth + 1)}){r.choice(['*', '+', '?', '{2}', '{1,3}', '{0,40}', '{2,30}', '{12}'])}"


def hung(*_):
    raise TimeoutError


def test_random_patterns_let_through_are_fast():
    """Texts of one or two repeated letters that just fail to match, where backtracking hurts most."""
    r = random.Random(7)
    texts = [t * (600 // len(t)) + end for t in ("a", "b", "ab", "aab", "ac") for end in ("", "!", "c")]
    before = signal.signal(signal.SIGALRM, hung)
    refused = passed = 0
    try:
        for _ in range(1500):
            pattern = made(r) + r.choice(["", "!", "d"])
            try:
                found = regex.compiled(regex.accepted(pattern))
            except regex.UnsupportedPattern:
                refused += 1
                continue
            passed += 1
            for text in texts:
                signal.setitimer(signal.ITIMER_REAL, 5)
                started = time.process_time()
                list(found.finditer(text))
                signal.setitimer(signal.ITIMER_REAL, 0)
                assert time.process_time() - started < 2, (pattern, text[:9])
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
    assert refused > 100 and passed > 400


def test_ways_are_those_of_the_engine():
    """A pattern refused as exponential really doubles: the engine's time on a failing text grows so."""
    for pattern in (r"(?:a|aa)*!", r"(a+)+!", r"(?:a{1,30}){1,30}!"):
        times = []
        for n in (17, 21):
            started = time.process_time()
            re.search(pattern, "a" * n)
            times.append(time.process_time() - started)
        assert times[1] > 2 * times[0], pattern
