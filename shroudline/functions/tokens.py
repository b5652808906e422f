"""Reversible tokens: ``[LABEL_TOKEN:PREFIX.nonce,ciphertext]`` around AES-256-GCM.

The payload is the JSON text ``{"label":…,"value":…}``.  The nonce is drawn per token, so two runs
give different tokens; compare what they open to, not the tokens.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE_BYTES = 12
PAYLOAD = "struct<label:string,value:string>"


def decode_key(raw: str) -> bytes:
    """32 key bytes from 64 hex digits or base64 (either alphabet)."""
    raw = raw.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{64}", raw):
        return bytes.fromhex(raw)
    plain = raw.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        key = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error as error:
        raise ValueError("the token key is neither hex nor base64") from error
    if len(key) != 32:
        raise ValueError(f"the token key has {len(key)} bytes, 32 are needed")
    return key


def check_prefix(prefix: str) -> str:
    if not prefix or any(mark in prefix for mark in ".,[]:"):
        raise ValueError(f"invalid token prefix {prefix!r}")
    return prefix


def _url_base64(data: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/", "-_"), F.lit("="))


def _from_url_base64(text: Column) -> Column:
    valid = text.rlike(r"^[A-Za-z0-9_-]*\z") & (F.char_length(text) % 4 != 1)
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(text), F.lit(4))))
    return F.when(valid, F.try_to_binary(padded, F.lit("base64")))


def tokenizer(key: bytes, prefix: str) -> Callable[[Column, Column], Column]:
    """A function (label, value) → token column."""
    check_prefix(prefix)

    def seal(label: Column, value: Column) -> Column:
        payload = F.to_json(F.struct(label.alias("label"), value.alias("value"))).cast("binary")
        # one-element array: the sealed bytes are random, so they must be bound once and cut twice
        sealed = F.array(F.aes_encrypt(payload, F.lit(key), F.lit("GCM")))
        return F.element_at(
            F.transform(
                sealed,
                lambda s: F.concat(
                    F.lit("["), F.upper(label), F.lit(f"_TOKEN:{prefix}."),
                    _url_base64(F.substring(s, F.lit(1), F.lit(NONCE_BYTES))), F.lit(","),
                    _url_base64(F.substring(s, F.lit(NONCE_BYTES + 1), F.octet_length(s))), F.lit("]"),
                ),
            ),
            1,
        )

    return seal


def detokenize(token: Column, key: bytes, prefix: str) -> Column:
    """``struct<label,value>`` inside a bracketed or bare token; NULL where it does not open."""
    check_prefix(prefix)
    shape = rf"^{re.escape(prefix)}\.([^,]*),([\s\S]*)\z"

    def bare(trimmed: Column) -> Column:
        bracketed = F.regexp_extract(trimmed, r"^\[[^:]*:([\s\S]*)\]\z", 1)
        return F.when(trimmed.startswith("[") & trimmed.endswith("]"), bracketed).otherwise(trimmed)

    def halves(raw: Column) -> Column:
        return F.struct(F.regexp_extract(raw, shape, 1).alias("nonce"), F.regexp_extract(raw, shape, 2).alias("sealed"))

    def decoded(texts: Column) -> Column:
        return F.struct(_from_url_base64(texts["nonce"]).alias("nonce"), _from_url_base64(texts["sealed"]).alias("sealed"))

    def opened(parts: Column) -> Column:
        # what has another shape has an empty nonce
        whole = F.octet_length(parts["nonce"]) == NONCE_BYTES
        return F.when(whole, F.try_aes_decrypt(F.concat(parts["nonce"], parts["sealed"]), F.lit(key), F.lit("GCM")))

    return F.from_json(_once(F.trim(token), bare, halves, decoded, opened).cast("string"), PAYLOAD)


def _once(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """``value`` through the steps, each of which refers to the one before several times and has it worked out once."""
    out = F.array(value)
    for step in steps:
        out = F.transform(out, step)
    return F.element_at(out, 1)


def detokenize_for(role: Column, token: Column, key: bytes, prefix: str) -> Column:
    """``detokenize`` for callers with the role ``admin``; NULL for everybody else."""
    return F.when(role == "admin", detokenize(token, key, prefix))
