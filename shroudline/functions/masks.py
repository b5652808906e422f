"""Masking strategies as column functions of (matched value, label)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def placeholder(value: Column, label: Column) -> Column:
    return F.concat(F.lit("["), F.upper(label), F.lit("]"))


def partial_email(value: Column, label: Column | None = None) -> Column:
    at = F.locate("@", value)
    first = F.when(at == 1, F.lit("*")).otherwise(F.substring(value, 1, 1))
    domain = F.substring(value, at + 1, F.char_length(value))
    return F.when(at == 0, F.lit("[EMAIL]")).otherwise(F.concat(first, F.lit("***@"), domain))


def partial_phone(value: Column, label: Column | None = None) -> Column:
    return F.when(F.octet_length(value) < 7, F.lit("[PHONE]")).otherwise(
        F.concat(F.left(value, F.lit(3)), F.lit("****"), F.right(value, F.lit(4)))
    )


def keep_last4(value: Column, label: Column | None = None) -> Column:
    return F.when(F.octet_length(value) <= 4, F.lit("[ID]")).otherwise(
        F.concat(F.lit("*" * 12), F.right(value, F.lit(4)))
    )


def hashed(value: Column, label: Column) -> Column:
    return F.concat(F.lit("["), F.upper(label), F.lit(":"), F.substring(F.sha2(value, 256), 1, 12), F.lit("]"))


def full(value: Column | None = None, label: Column | None = None) -> Column:
    return F.lit("[REDACTED]")


MASKS: dict[str, Callable[[Column, Column], Column]] = {
    "placeholder": placeholder,
    "partial_email": partial_email,
    "partial_phone": partial_phone,
    "keep_last4": keep_last4,
    "hash": hashed,
    "full": full,
}


def apply_mask(value: Column, strategy: Column, label: Column, tokenizer: Callable[[Column, Column], Column] | None = None) -> Column:
    """The mask named by ``strategy``; ``tokenize`` without a tokenizer is an error, never a leak."""
    chain = None
    for name, mask in MASKS.items():
        chain = (F if chain is None else chain).when(strategy == name, mask(value, label))
    token = (
        tokenizer(label, value)
        if tokenizer
        else F.raise_error(F.lit("masking strategy 'tokenize' needs a token key")).cast("string")
    )
    return chain.when(strategy == "tokenize", token)
