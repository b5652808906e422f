"""Token ids of whole texts by the tokenizers library: texts fall into chunks, and each different chunk of a batch is looked up once.

Ids travel as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shroudline.llm.work import held

# Chunks, and pieces, of each of the two generations that a worker remembers; what was forgotten is encoded anew, with the same ids.
REMEMBERED = 250_000

# Bytes of text that are encoded at a time: each different chunk among them is looked up once.
SLICE = 8 << 20

# White space and controls on which pattern engines differ; texts with them, or with a special token, are encoded whole.
ODD = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|<\\|"
# A space before white space or the end, which belongs to no piece behind it.
LOOSE = " [\\t-\\r ]| $"
# Chunks of these characters are split here; others are left to the library.
PLAIN = re.compile("[\t-\r -\u012f\u0131-\u024f]*\\Z")
# Behind letters a run of these is one piece.
ENDS = ".,;:!?)]}\"*%&$#|/-=+_"
SPACE = re.compile(r" (?=\S)")
CUT = re.compile(r"\S (?=\S)")

# The piece patterns of the two tokenizers, for the characters of PLAIN.
LETTER, NUMBER, OTHER = r"[^\W\d_²³¹¼½¾]", r"[\d²³¹¼½¾]", r"(?:[^\s\w]|_)"
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+")


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Recent:
    """Values by key, made once while they are in use: what a whole generation of new keys has not asked for is forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED) -> None:
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def one(self, key: str) -> bytes:
        value = self.young.get(key)
        return self.all([key])[0] if value is None else value

    def all(self, keys: list[str]) -> list[bytes]:
        young, old, make = self.young, self.old, self.make
        out = list(map(young.get, keys))
        for i in [i for i, value in enumerate(out) if value is None]:
            key = keys[i]
            value = old.get(key)
            if value is None:
                value = make(key)
            out[i] = young[key] = value
        if len(young) > self.most and young is self.young:
            self.old, self.young = young, {}
        return out


class Encoder:
    # what stands before a chunk and belongs to its first piece
    before = ""

    def __init__(self, path: str, most: int = REMEMBERED, slice_: int = SLICE) -> None:
        from tokenizers import Tokenizer

        self.slice = slice_

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.chunks = Recent(self.chunk, most)
        self.pieces = Recent(self.piece, most)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, shown: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def piece(self, piece: str) -> bytes:
        return self.ids(piece.encode().decode("latin-1").translate(self.symbols))

    def chunk(self, chunk: str) -> bytes:
        """Letters are one piece, and so are the marks of ENDS behind them; other chunks are split by pattern."""
        core = chunk if chunk.isalpha() else chunk.rstrip(ENDS)
        if core.isalpha() and (core.isascii() or PLAIN.match(core)):
            return self.word(core) if core is chunk else self.chunks.one(core) + self.pieces.one(chunk[len(core) :])
        return self.split(self.before + chunk)

    def word(self, word: str) -> bytes:
        raise NotImplementedError

    def split(self, chunk: str) -> bytes:
        raise NotImplementedError

    def cut(self, texts: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Chunks per text, the code of each chunk, and the ids by code; where ``apart`` holds the chunks do not count."""
        raise NotImplementedError

    def looked_up(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Each different chunk of the batch is asked for once."""
        found = lists.flatten().dictionary_encode()
        return lists.value_lengths().to_numpy(), found.indices.to_numpy().astype(np.int64), self.chunks.all(found.dictionary.to_pylist())

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and where each text's begin; one number more than texts."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        many, codes, values = self.cut(texts, odd)
        many, first = many.astype(np.int64), np.r_[0, np.cumsum(many, dtype=np.int64)][:-1]
        # a text encoded whole is one chunk of its own, and the end is one more chunk of every text
        at = np.flatnonzero(odd)
        codes[first[at]] = len(values) + np.arange(len(at))
        values = [*values, *(self.whole(texts[int(i)].as_py()) for i in at), end]
        kept = np.ones(len(codes), bool)
        if len(at):
            kept = np.repeat(~odd, many)
            kept[first[at]] = True
            many[at] = 1
        ends = np.cumsum(many)
        codes = np.insert(codes[kept], ends, len(values) - 1)
        size = np.fromiter((len(v) // 4 for v in values), np.int64, len(values))
        flat, start = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        sizes = size[codes]
        total = np.r_[0, np.cumsum(sizes)]
        ids = flat[np.arange(total[-1]) + np.repeat(start[codes] - total[:-1], sizes)]
        return ids, total[np.r_[0, ends + np.arange(1, len(ends) + 1)]]

    def each(self, texts: pa.Array, end: bytes = b"") -> Iterator[np.ndarray]:
        """Ids of each text and ``end``, about SLICE bytes of text at a time; a longer text goes through in parts."""
        total = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + self.slice, side="right")) - 1)
            if total[hi] - total[lo] > self.slice:
                yield np.frombuffer(self.encode(texts[lo].as_py()) + end, "<u4")
            else:
                ids, at = self.batch(texts.slice(lo, hi - lo), end)
                yield from np.split(ids, at[1:-1])
            lo = hi

    def encode(self, text: str) -> bytes:
        """Ids of one text.  It is cut where a space stands between characters that are none, which is the end of a piece."""
        parts = [text]
        if len(text) > self.slice and not pc.match_substring_regex(pa.array([text], pa.large_string()), ODD)[0].as_py():
            cuts = [0]
            while (found := CUT.search(text, cuts[-1] + self.slice)) is not None:
                cuts.append(found.start() + 1)
            parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        elif len(text) > self.slice:
            return self.whole(text)
        return b"".join(self.batch(pa.array([part], pa.string()))[0].tobytes() for part in parts)


class ByteLevel(Encoder):
    """Byte-level BPE.  A space before a character that is no white space always starts a piece, so chunks are cut there."""

    before = " "

    def cut(self, texts: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        loose = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False) & ~apart
        lists = pc.split_pattern(texts, " ")
        if loose.any():
            rows = lists.to_pylist()
            for i in np.flatnonzero(loose):
                rows[i] = SPACE.split(texts[int(i)].as_py())
            lists = pa.array(rows, lists.type)
        many, codes, values = self.looked_up(lists)
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        codes[first] = len(values) + np.arange(len(first))  # no space before it
        leading = lists.flatten().take(pa.array(first)).to_pylist()
        return many, codes, [*values, *(b"" if gone else self.split(c) for c, gone in zip(leading, apart, strict=True))]

    def word(self, word: str) -> bytes:
        """A word behind a space, which is shown as one character."""
        return self.ids(f"\u0120{word}") if word.isascii() else self.piece(f" {word}")

    def split(self, chunk: str) -> bytes:
        return b"".join(self.pieces.all(BYTE_PIECES.findall(chunk))) if PLAIN.match(chunk) else self.whole(chunk)


class WordLevel(Encoder):
    """BPE with word ends, lower case, white space dropped: chunks are what stands between white space."""

    def cut(self, texts: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return self.looked_up(pc.ascii_split_whitespace(pc.ascii_lower(texts)))

    def word(self, word: str) -> bytes:
        return self.ids(word) if word.isascii() else self.piece(word.lower())

    def split(self, chunk: str) -> bytes:
        return b"".join(self.pieces.all(WORD_PIECES.findall(chunk.lower()))) if PLAIN.match(chunk) else self.whole(chunk)


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder; ``kind`` is ``byte`` or ``word``."""
    return held(("encoder", path, kind), lambda: {"byte": ByteLevel, "word": WordLevel}[kind](path))
