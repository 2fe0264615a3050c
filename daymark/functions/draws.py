"""Reproducible draws: the same key gives the same value on every run and retry.

One MD5 per row is four independent 32-bit draws, cut from its hex text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4


def digest(seed: int, label: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{label}"), *[k.cast("string") for k in keys]))


def draw(digest: Column, slot: int) -> Column:
    """Draw number ``slot`` (0 to 3) of a digest, 0 to 2**32 - 1."""
    if not 0 <= slot < DRAWS_PER_DIGEST:
        raise ValueError(f"a digest holds {DRAWS_PER_DIGEST} draws, asked for slot {slot}")
    return F.conv(F.substring(digest, 1 + 8 * slot, 8), 16, 10).cast("long")


def int_between(value: Column, low: int, high: int) -> Column:
    """A draw mapped to the closed range [low, high]."""
    return F.lit(low).cast("long") + value % F.lit(high - low + 1).cast("long")


def date_between(value: Column, first: dt.date, end: dt.date) -> Column:
    """A draw mapped to the half-open range [first, end)."""
    return F.date_add(F.lit(first), (value % F.lit((end - first).days)).cast("int"))


def pick(value: Column, words: Sequence[str]) -> Column:
    """A draw mapped to one of a fixed list.  The list is one literal once planned."""
    if any("|" in w for w in words):
        raise ValueError("words must not contain |")
    listed = F.split(F.lit("|".join(words)), r"\|")
    return F.element_at(listed, (value % F.lit(len(words))).cast("int") + F.lit(1))
