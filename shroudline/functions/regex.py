"""One rule pattern, three engines.

Rules are written for a linear-time engine without look-around.  They run here in Python
(exact spans), RE2 through Arrow (batch pre-filter) and Java (column expressions), which
differ in what ``$`` and the class shorthands mean.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

_UNSUPPORTED = ("(?=", "(?!", "(?<=", "(?<!", "(?>")

# Class shorthands spelled out for RE2, whose own are ASCII only.  Each is at least as wide as
# the meaning used for spans, so the pre-filter never loses a row.
_WIDE = {
    "d": r"\p{Nd}",
    "w": r"\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}",
    "s": r"\t-\r\x1C-\x20\x{85}\p{Z}",
}


class UnsupportedPattern(ValueError):
    """The pattern uses a construct outside the rule dialect."""


# POSIX classes, ASCII as in the rule dialect, as members of a character class.
_POSIX = {
    "alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_",
    "space": r"\x09-\x0d\x20", "blank": r"\x09\x20", "cntrl": r"\x00-\x1f\x7f", "punct": r"!-/:-@\[-`{-~", "graph": "!-~", "print": r"\x20-~", "ascii": r"\x00-\x7f",
}


def _tokens(pattern: str):
    """(token, inside a character class) pairs; an escape is one token.

    Inside a class ``[`` and a leading ``]`` stand for themselves and come out escaped, because the engines differ on
    them; a POSIX class comes out as its members.
    """
    i, inside, first = 0, False, False
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if not inside:
            yield token, False
            inside = first = token == "["
            continue
        if first and token == "^":
            yield token, True
            continue
        if token == "]" and not first:
            inside = False
            yield token, False
            continue
        first = False
        if token == "[" and (named := re.match(r":(\w+):\]", pattern[i:])) and named[1] in _POSIX:
            i += named.end()
            token = _POSIX[named[1]]
        elif token in ("[", "]", "&", "~"):
            token = f"\\{token}"  # Java and the wider engine read [[, && and ~~ as set operations
        yield token, True


def check(pattern: str) -> str:
    if any(mark in pattern for mark in _UNSUPPORTED):
        raise UnsupportedPattern(f"look-around is not supported: {pattern}")
    if "(?P=" in pattern or any(re.fullmatch(r"\\[1-9gk]", token) for token, inside in _tokens(pattern) if not inside):
        raise UnsupportedPattern(f"back references are not supported: {pattern}")
    return pattern


def _end_anchor(pattern: str, anchor: str) -> str:
    if re.match(r"\(\?[a-z]*m", pattern):
        anchor = "$"
    return "".join(anchor if token == "$" and not inside else token for token, inside in _tokens(pattern))


def to_python(pattern: str) -> str:
    return _end_anchor(check(pattern).replace(r"\z", r"\Z"), r"\Z")


def to_java(pattern: str) -> str:
    """Same meaning for ``java.util.regex``: strict end anchor, Unicode class shorthands."""
    fixed = _end_anchor(check(pattern), r"\z")
    uses_class = any(token in (r"\d", r"\w", r"\s", r"\b", r"\D", r"\W", r"\S", r"\B") for token, _ in _tokens(fixed))
    return "(?U)" + fixed if uses_class else fixed


def to_re2(pattern: str) -> str | None:
    """A pattern RE2 accepts that matches wherever the rule does, or None if there is none."""
    if re.match(r"\(\?[a-z]*[^a-z:]*x", pattern):
        return None
    out = []
    for token, inside in _tokens(check(pattern)):
        if token in (r"\b", r"\B", r"\D", r"\W", r"\S", r"\Z"):
            return None
        if token[0] == "\\" and token[1:] in _WIDE:
            wide = _WIDE[token[1:]]
            out.append(wide if inside else f"[{wide}]")
        else:
            out.append(token)
    test = "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), test)
    except pa.ArrowInvalid:
        return None  # counts beyond its limit, for one: every text is then read for spans
    return test


@lru_cache(maxsize=1024)
def compiled(pattern: str):
    """Compile for span extraction; the wider engine is used only where ``re`` refuses."""
    source = to_python(pattern)
    try:
        found = re.compile(source)
    except re.error as refused:
        import regex

        try:
            found = regex.compile(source)
        except regex.error:
            raise refused from None
    if growth(source) == EXPONENTIAL:
        raise UnsupportedPattern(f"overlapping ways round a repeat take exponential time: {pattern}")
    return found


def accepted(pattern: str) -> str:
    """A rule that may be loaded: in the dialect, and of bounded growth in time."""
    compiled(pattern)
    if (most := growth(to_python(pattern))) > CHAINED:
        raise UnsupportedPattern(f"{most} repeats behind each other share text, which takes more than the square of its length: {pattern}")
    return pattern


# Characters on which two parts of a pattern are compared: ASCII and a few beyond.
_PROBES = [chr(c) for c in range(128)] + ["\xa0", "\xe9", "\u0660", "\u4e2d", "\u2028"]
# Property classes of the wider engine, by what of the probes they hold.
_PROPERTIES = {"L": "A-Za-z\xe9\u4e2d", "Lu": "A-Z", "Ll": "a-z\xe9", "N": "0-9\u0660", "Nd": "0-9\u0660", "P": "!-/:-@\\[-`{-~", "Z": " \xa0\u2028", "Zs": " \xa0"}

# A repeat is taken as one without end if it leaves this much choice, or if a body that can itself match in several lengths
# is repeated more often than UNROLLED; others are written out, at most LONGEST copies.
CHOICE, UNROLLED, LONGEST = 8, 4, 64
# Repeats behind each other that can share a text, each of which takes up to n steps on n characters, besides n places to start.
CHAINED = 1
# Character places of a pattern that are compared; a longer pattern is refused.
PLACES = 4000


# A pattern that takes exponential time, or that cannot be judged.
EXPONENTIAL = 1_000_000


@lru_cache(maxsize=1024)
def growth(source: str) -> int:
    """How many repeats of a pattern can share a text, each multiplying a backtracking engine's steps by its length.

    The pattern becomes an automaton of character places.  Two ways round a loop for the same text double with each
    round: exponential.  Loops behind each other that can pass text from one to the next multiply.
    """
    def plain(m: re.Match) -> str:
        members = _PROPERTIES.get(m[2] or m[3], r"\w")
        return f"[{'^' if m[1] == 'P' else ''}{members}]"

    try:
        tree = re._parser.parse(source)
    except re.error:
        try:
            # classes in classes only widen what a place takes
            tree = re._parser.parse(re.sub(r"\\([pP])(?:\{\^?(\w+)\}|(\w))", lambda m: plain(m)[1:-1] if _in_class(source, m.start()) else plain(m), source))
        except re.error:
            return EXPONENTIAL
    try:
        return _Places(tree, tree.state.flags).judge()
    except OverflowError:
        return EXPONENTIAL


def _in_class(source: str, at: int) -> bool:
    position = 0
    for token, inside in _tokens(source):
        if position >= at:
            return inside
        position += len(token)
    return False


class _Part:
    """What a piece of a pattern starts and ends with, counted by ways; ``empty`` counts the ways to match nothing."""

    def __init__(self, empty: int = 0, first: dict | None = None, last: dict | None = None, varies: bool = False) -> None:
        self.empty, self.first, self.last, self.varies = empty, first or {}, last or {}, varies


def _sum(*counts: dict) -> dict:
    out: dict = {}
    for some in counts:
        for key, n in some.items():
            out[key] = min(2, out.get(key, 0) + n)
    return out


def _times(counts: dict, n: int) -> dict:
    return {key: min(2, n * m) for key, m in counts.items()} if n else {}


class _Places:
    """Character places of a pattern and the ways from each to the next (2 stands for two and more)."""

    def __init__(self, tree, flags: int) -> None:
        self.flags = flags
        self.takes: list[frozenset] = []
        self.next: list[dict[int, int]] = []
        self.sets: dict = {}
        self.sequence(tree)

    def place(self, name: str, arg) -> _Part:
        key = (name, repr(arg))
        if key not in self.sets:
            self.sets[key] = frozenset(c for c in _PROBES if _takes(name, arg, c, self.flags))
        if len(self.takes) >= PLACES:
            raise OverflowError
        self.takes.append(self.sets[key])
        self.next.append({})
        here = {len(self.takes) - 1: 1}
        return _Part(0, here, here)

    def follow(self, last: dict, first: dict, ways: int = 1) -> None:
        for p, n in last.items():
            for q, m in first.items():
                self.next[p][q] = min(2, self.next[p].get(q, 0) + n * m * ways)

    def joined(self, a: _Part, b: _Part) -> _Part:
        self.follow(a.last, b.first)
        return _Part(min(2, a.empty * b.empty), _sum(a.first, _times(b.first, a.empty)), _sum(b.last, _times(a.last, b.empty)), a.varies or b.varies)

    def sequence(self, items) -> _Part:
        out = _Part(1)
        for op, arg in items:
            out = self.joined(out, self.item(str(op), arg))
        return out

    def item(self, name: str, arg) -> _Part:
        if name == "AT":
            return _Part(1)
        if name == "SUBPATTERN":
            return self.sequence(arg[3])
        if name == "ATOMIC_GROUP":
            return self.sequence(arg)
        if name == "BRANCH":
            parts = [self.sequence(branch) for branch in arg[1]]
            return _Part(min(2, sum(p.empty for p in parts)), _sum(*(p.first for p in parts)), _sum(*(p.last for p in parts)), True)
        if name.endswith("_REPEAT"):
            return self.repeat(*arg)
        return self.place(name, arg)

    def repeat(self, low: int, high, body) -> _Part:
        start = len(self.takes)
        part = self.sequence(body)
        endless = high == re._constants.MAXREPEAT or high - low >= CHOICE or ((part.varies or part.empty) and high > UNROLLED)
        if endless:
            self.follow(part.last, part.first, 2 if part.empty else 1)
            return _Part(1 if low == 0 else part.empty, part.first, part.last, True)
        if (min(high, LONGEST) or 1) * (len(self.takes) - start) > PLACES:
            raise OverflowError
        out = _Part(1)
        for i in range(min(high, LONGEST)):
            if i:
                part = self.sequence(body)
            if i >= low:  # this copy and all behind it may be left out
                part = _Part(part.empty + 1, part.first, part.last, True)
            out = self.joined(out, part)
        if high > low:  # left-out copies in between are one choice, not many
            out = _Part(min(out.empty, 1) if low == 0 else out.empty, {p: 1 for p in out.first}, out.last, True)
        return out

    def loops(self) -> list[list[int]]:
        """Strongly connected places, in order of a walk that meets later loops first."""
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        held, path, out = set(), [], []
        for root in range(len(self.next)):
            if root in index:
                continue
            stack = [(root, iter(self.next[root]))]
            index[root] = low[root] = len(index)
            path.append(root)
            held.add(root)
            while stack:
                at, rest = stack[-1]
                for to in rest:
                    if to not in index:
                        index[to] = low[to] = len(index)
                        path.append(to)
                        held.add(to)
                        stack.append((to, iter(self.next[to])))
                        break
                    if to in held:
                        low[at] = min(low[at], index[to])
                else:
                    stack.pop()
                    if stack:
                        low[stack[-1][0]] = min(low[stack[-1][0]], low[at])
                    if low[at] == index[at]:
                        mine = []
                        while not mine or mine[-1] != at:
                            mine.append(path.pop())
                            held.discard(mine[-1])
                        if len(mine) > 1 or at in self.next[at]:
                            out.append(mine)
        return out

    def doubles(self, loop: list[int]) -> bool:
        """Whether some text leads round the loop in two ways."""
        inside = set(loop)
        steps = {p: [q for q in self.next[p] if q in inside] for p in loop}
        if any(n > 1 for p in loop for q, n in self.next[p].items() if q in inside):
            return True
        open_, seen = [], set()
        for p in loop:
            open_ += [(a, b) for a in steps[p] for b in steps[p] if a < b and self.takes[a] & self.takes[b]]
        while open_:
            pair = open_.pop()
            if pair in seen:
                continue
            seen.add(pair)
            if len(seen) > PLACES * 50:
                raise OverflowError
            for a in steps[pair[0]]:
                for b in steps[pair[1]]:
                    if a == b:
                        return True
                    if self.takes[a] & self.takes[b]:
                        open_.append((min(a, b), max(a, b)))
        return False

    def judge(self) -> int:
        loops = self.loops()
        if any(self.doubles(loop) for loop in loops):
            return EXPONENTIAL
        chain = [1] * len(loops)
        for i, loop in enumerate(loops):  # later loops come first
            reached, open_ = set(), list(loop)
            while open_:
                at = open_.pop()
                if at not in reached:
                    reached.add(at)
                    open_ += self.next[at]
            for j in range(i):
                if loops[j][0] in reached and chain[j] >= chain[i] and self.hands_over(loop, loops[j], reached):
                    chain[i] = chain[j] + 1
        return max(chain, default=0)

    def hands_over(self, a: list[int], b: list[int], between: set[int]) -> bool:
        """Whether one text leads round loop ``a``, from ``a`` to ``b``, and round ``b``: then each may take any share of many such."""
        in_a, in_b, seen = set(a), set(b), 0
        for p in a:
            for q in b:
                open_, met = [(p, p, q)], set()
                while open_:
                    x, y, z = open_.pop()
                    for x2 in self.next[x]:
                        for z2 in self.next[z]:
                            if x2 not in in_a or z2 not in in_b or not (common := self.takes[x2] & self.takes[z2]):
                                continue
                            for y2 in self.next[y]:
                                if y2 in between and common & self.takes[y2] and (x2, y2, z2) not in met:
                                    if (x2, y2, z2) == (p, q, q):
                                        return True
                                    met.add((x2, y2, z2))
                                    open_.append((x2, y2, z2))
                                    seen += 1
                                    if seen > PLACES * 50:
                                        raise OverflowError
        return False


def _takes(name: str, arg, char: str, flags: int) -> bool:
    if name == "ANY":
        return char != "\n" or bool(flags & re.S)
    wanted = {char, char.lower(), char.upper()} if flags & re.I else {char}
    if name in ("LITERAL", "NOT_LITERAL"):
        return (chr(arg) in wanted) == (name == "LITERAL")
    if name != "IN":
        return True
    found = negated = False
    for kind, value in arg:
        kind = str(kind)
        if kind == "NEGATE":
            negated = True
        elif kind == "LITERAL":
            found |= chr(value) in wanted
        elif kind == "RANGE":
            found |= any(len(c) == 1 and value[0] <= ord(c) <= value[1] for c in wanted)
        elif kind == "CATEGORY":
            letter = {"DIGIT": "d", "SPACE": "s", "WORD": "w"}[str(value).rsplit("_", 1)[-1]]
            found |= bool(re.match(f"\\{letter.upper() if 'NOT' in str(value) else letter}", char))
    return found != negated


def has_group(pattern: str) -> bool:
    return compiled(pattern).groups > 0
