"""Random numbers as columns: each is worked out from a seed and the key and index of its row alone.

A row has the same number in every run, on every executor and after a task runs again, in any order of rows
and with any partitions. The bits are those of an MD5 digest, so that other engines give the same numbers.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a number, 4 bits each: 52 bits are whole in a double.
DIGITS = 13


def _bits(seed: int, parts: tuple[Column, ...], stream: int) -> Column:
    text = F.concat(F.lit(str(seed)), *[F.concat(F.lit(":"), F.coalesce(p.cast("string"), F.lit("null"))) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1 + stream * DIGITS, DIGITS), 16, 10).cast("long")


def uniform(seed: int, *parts: Column, stream: int = 0) -> Column:
    """A number of [0, 1) from 52 bits for a seed and the values that tell a row, null among them; `stream` 0 and 1 are independent."""
    return _bits(seed, parts, stream).cast("double") / float(1 << 4 * DIGITS)


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number from the two uniform ones of a row (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *parts))) * F.cos(2 * math.pi * uniform(seed, *parts, stream=1))


def integer(seed: int, low: int, high: int, *parts: Column) -> Column:
    """A whole number from `low` on, under `high`."""
    if high <= low:
        raise ValueError("no whole number lies between these bounds")
    return F.lit(low) + F.floor(uniform(seed, *parts) * (high - low))


def choice(seed: int, weights: dict[str, float], *parts: Column) -> Column:
    """One of the names, as often as their weights say."""
    if not weights or min(weights.values()) < 0 or not sum(weights.values()):
        raise ValueError("weights are 0 or more, and not all 0")
    u = uniform(seed, *parts) * float(sum(weights.values()))
    names = [n for n, w in weights.items() if w > 0]
    out = F.lit(names[-1])
    for name, edge in list(zip(names, accumulate(weights[n] for n in names)))[-2::-1]:
        out = F.when(u < edge, name).otherwise(out)
    return out
