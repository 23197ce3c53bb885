"""Fill-in-middle: a text is cut at two line borders and its middle goes behind prefix and suffix.

The units of a text are its lines, each with its line feed (``[^\\n]*\\n|[^\\n]+``). The ends of the units are a
compressed set of numbers: those of equal upper 16 bits share a container, which is an array, a bitmap or a
list of runs, whatever is smallest, and the containers' sizes are added up. The end of the k-th unit is found by
searching the sums for its container, and inside by looking it up (array), by adding up the bits of words
(bitmap) or by searching the runs.

Where a text is cut follows from its id alone: the first four 8-digit groups of the hex SHA-256 of
``seed:id`` are h1 to h4. With n units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
units and the middle after the larger. The form is

* plain (the text itself) if it is empty, holds a marker, or h3 % 100 >= ``rate``;
* spm (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) if h4 % 100 < ``spm``;
* psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) otherwise.

A marker is never in a text that is cut, and two parts and a marker between them cannot make another one, so
the markers tell the parts apart again and ``restored`` gives back the text exactly.

Texts are cut where they lie, without a shuffle; a task holds a few megabytes of text, or one longer text.
Null texts count as empty and give an empty output; a null id counts as an empty one. Equal ids cut alike, equal
rows give equal rows, an empty table gives none. Other columns stay as they are, those named like a result
are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import text_chunks
from flowlens.runtime import column as named

MARKERS = ("<P>", "<S>", "<M>")
RESULTS = [("n", "bigint"), ("form", "string"), ("output", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint")]
_CHUNK = 1 << 22
_WORDS = 1024


class ArrayContainer:
    """Up to 65,536 numbers below 65,536, one by one."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each number below 65,536, and how many are set before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(64 * _WORDS, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    """Runs of consecutive numbers by their starts, and how many numbers lie before each."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.starts, self.before = low[first], first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run] + k - self.before[run])


def container(low: np.ndarray):
    """The smallest of the three: 2 bytes a number, 8,192 in all, or 4 bytes a run."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = (4 * len(first), 2 * len(low), 8 * _WORDS)
    if sizes[0] < min(sizes[1:]):
        return RunContainer(low, first)
    return ArrayContainer(low) if sizes[1] <= sizes[2] else BitmapContainer(low)


class BoundarySet:
    """Rising numbers in containers by their upper bits; ``before`` are the sizes added up."""

    def __init__(self, numbers: np.ndarray):
        high = numbers >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.before = first.tolist()
        self.keys = high[first].tolist()
        ends = [*self.before[1:], len(numbers)]
        self.containers = [container(numbers[a:b] & 0xFFFF) for a, b in zip(self.before, ends)]
        self.size = len(numbers)

    def select(self, k: int) -> int:
        """The k-th smallest number, from 0."""
        at = bisect_right(self.before, k) - 1
        return self.keys[at] << 16 | self.containers[at].select(k - self.before[at])


def unit_ends(raw: np.ndarray) -> BoundarySet:
    """Where the lines of a text in UTF-8 end."""
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and raw[-1] != 10:
        ends = np.append(ends, len(raw))
    return BoundarySet(ends)


def _code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def draws(seed: int, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4)]


def cut(raw: np.ndarray, h: list[int], rate: int, spm: int) -> tuple[int, str, list[bytes], int | None, int | None]:
    """(units, form, what the output is joined from, code points of prefix and of middle)."""
    p, s, m = (x.encode() for x in MARKERS)
    whole, ends = raw.tobytes(), unit_ends(raw)
    if not whole or h[2] % 100 >= rate or p in whole or s in whole or m in whole:
        return ends.size, "plain", [whole], None, None
    low, high = sorted((h[0] % (ends.size + 1), h[1] % (ends.size + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (low, high))
    prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    joined = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
    return ends.size, form, joined, _code_points(raw[:a]), _code_points(raw[a:b])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50
) -> DataFrame:
    """All columns of ``docs`` with ``n``, ``form``, ``output``, ``prefix_chars`` and ``middle_chars``."""
    added = [name for name, _ in RESULTS]
    kept = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    key, text = _free(kept, "_key"), _free(kept, "_text")
    # the key and the text go along under names of their own, as a result may replace their columns
    ready = kept.withColumns({key: F.coalesce(named(id_col).cast("string"), F.lit("")), text: named(text_col).cast("string")})
    ready = ready.drop(*[c for c in added if c in ready.columns])
    others = [c for c in ready.columns if c not in (key, text)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text))
            for first, last, data, offsets in text_chunks(texts, _CHUNK):
                found = [cut(data[offsets[k] : offsets[k + 1]], draws(seed, keys[first + k]), rate, spm) for k in range(last - first)]
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows.column(rows.schema.get_field_index(c)) for c in others],
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.string()),
                        _strings([x[2] for x in found]),
                        pa.array([x[3] for x in found], pa.int64()),
                        pa.array([x[4] for x in found], pa.int64()),
                    ],
                    names=[*others, *added],
                )

    schema = ready.select(*[named(c) for c in others], *[F.lit(None).cast(t).alias(c) for c, t in RESULTS]).schema
    return ready.mapInArrow(work, schema)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _strings(joined: list[list[bytes]]) -> pa.Array:
    """A string column from UTF-8 pieces, without decoding them."""
    ends = np.cumsum([0, *[sum(map(len, parts)) for parts in joined]]).astype(np.int32)
    data = b"".join(part for parts in joined for part in parts)
    return pa.StringArray.from_buffers(len(joined), pa.py_buffer(ends), pa.py_buffer(data))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; null for a null output."""
    parts = F.split(output, "|".join(MARKERS), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
