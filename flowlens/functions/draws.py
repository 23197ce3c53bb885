"""Reproducible draws: a row's draw depends on its key and the seed only.

``rand()`` and ``randomSplit`` depend on how rows are spread over partitions, so a retried
task or another cluster size gives other rows. An md5 of seed and key does not, and any SQL
engine can recompute it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 32


def draw_key(seed: int | str, *keys: Column) -> Column:
    """32 hex digits, uniform over the key space."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of the draw key."""
    return F.conv(F.substring(draw_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(_RANGE))


def hex_bound(fraction: float) -> str:
    """``draw_key < hex_bound(f)`` holds for a share ``f`` of the keys; compares text, converts nothing."""
    cut = math.ceil(fraction * _RANGE)
    return "g" if cut >= _RANGE else format(max(cut, 0), "08x")


def drawn_below(key: Column, fraction: float) -> Column:
    return key < F.lit(hex_bound(fraction))
