"""Vector codes: every vector becomes one small number for each of its parts, by exact integer arithmetic.

A component x becomes floor(``scale`` * x). Vectors are cut into ``parts`` equal consecutive parts, each with a
codebook of its own. A codebook starts as that part of the vectors with the ``entries`` smallest ids. In each
round every part goes to its nearest entry (squared Euclidean distance, of equal ones the lower index), and an
entry becomes floor(sum / count) of its parts, component by component; an entry without parts stays.

Rows stay where they are. A task gathers its vectors in chunks of a few megabytes; within a chunk the parts
of one position are sorted along a Hilbert curve, so that neighbours in the sort are near each other in all
dimensions, and laid down flat in blocks of ``BLOCK`` parts, each block with its smallest and largest components
(its box) and its sums. Chunks are written once to the shared folder and read in every round. A round compares
boxes with entries first: an entry whose least distance to a box is above the largest distance of another one is
nearest to nothing in the block, and neither is one that is farther than the entry nearest to the box's centre from
every place in the box. What is left is the block's shortlist. A shortlist of one needs no look at
the parts, as the block's sums are known; for longer ones the distances are computed in whole numbers. From a task
come sums and counts of entries, which have a fixed number whatever the table; codebooks are the only thing that
reaches the driver. Results do not depend on how the table is partitioned.

Rows whose vector is null or empty, or holds null or non-finite components, are left out, as are those whose
length is no multiple of ``parts``, or not the most frequent one among the rest (of equally frequent ones the
largest). Components beyond +-2**24 after scaling count as +-2**24, so that distances fit 64 bits. Null ids come last
in the order of ids; of equal ids the smaller vector comes first. With fewer than ``entries`` vectors the
codebooks are that much smaller. Equal rows give equal rows; without vectors nothing is returned. A sum of errors
beyond 64 bits is null. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column as named
from flowlens.runtime import materialise, small_side

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 32
LARGEST = 1 << 24
#: Bytes of components in a chunk, at four bytes each.
CHUNK_BYTES = 1 << 22
#: Labels up to this number are joined by a broadcast of their sums.
MAX_LABELS = 10_000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]`` are the components of an entry, whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# Chunks ----------------------------------------------------------------------------------------


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors * float(scale)), -LARGEST, LARGEST).astype(np.int32)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """The place of each row along a Hilbert curve through the box of all rows."""
    width = min(points.shape[1], 62)
    bits = max(1, min(10, 62 // width))
    low, high = points.min(axis=0), points.max(axis=0)
    cells = ((points - low) * float(1 << bits) / (high - low + 1.0)).astype(np.int64)
    x = [cells[:, k].copy() for k in range(width)]
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(width):
            turned = (x[k] & q) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swapped)
            x[k] ^= swapped
        q >>= 1
    for k in range(1, width):
        x[k] ^= x[k - 1]
    flip = np.zeros(len(points), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(points), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(width):
            key = key << 1 | (((x[k] ^ flip) >> bit) & 1)
    return key


_CHUNK_FIELDS = [("order", "binary"), ("flat", "binary"), ("low", "binary"), ("high", "binary"), ("sums", "binary")]


def laid_flat(vectors: np.ndarray, parts: int) -> dict[str, bytes]:
    """The parts of a chunk position by position in Hilbert order, with boxes and sums of their blocks."""
    n, width = vectors.shape[0], vectors.shape[1] // parts
    starts = np.arange(0, n, BLOCK)
    found = {name: [] for name, _ in _CHUNK_FIELDS}
    for k in range(parts):
        part = vectors[:, k * width : (k + 1) * width]
        order = np.argsort(hilbert_keys(part), kind="stable")
        part = part[order]
        found["order"].append(order.astype(np.int32))
        found["flat"].append(part)
        found["low"].append(np.minimum.reduceat(part, starts))
        found["high"].append(np.maximum.reduceat(part, starts))
        found["sums"].append(np.add.reduceat(part.astype(np.int64), starts))
    return {name: np.stack(x).tobytes() for name, x in found.items()}


def _chunked(width: int, parts: int, scale: int):
    rows = max(BLOCK, CHUNK_BYTES // (4 * width))

    def chunk(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        vectors = np.concatenate([c.flatten().to_numpy() for c in table.column("vec").chunks]).reshape(-1, width)
        made = laid_flat(whole_numbers(vectors, scale), parts)
        lists = []
        for name in ("id", "label"):
            column = table.column(name)
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
        binary = [pa.array([made[name]], pa.binary()) for name, _ in _CHUNK_FIELDS]
        return pa.RecordBatch.from_arrays([*lists, *binary], names=["id", "label", *made])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            while table.num_rows:
                took = table.slice(0, rows - count)
                held.append(took)
                count += took.num_rows
                table = table.slice(took.num_rows)
                if count == rows:
                    yield chunk(held)
                    held, count = [], 0
        if count:
            yield chunk(held)

    return work


# Assignment ------------------------------------------------------------------------------------


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Per block and entry whether the entry can be nearest to a part inside the block's box."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    below, above = low[:, None] - entries[None], entries[None] - high[:, None]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    short = (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]
    # the difference of two squared distances is linear in the place, so it is largest in a corner of the box
    twice = low + high
    middle = ((twice[:, None] - 2 * entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    away = entries[middle][:, None] - entries[None]
    squares = (entries * entries).sum(axis=1)
    corner = np.where(away > 0, low[:, None] * away, high[:, None] * away).sum(axis=2)
    return short & (squares[middle][:, None] - squares[None] >= 2 * corner)


def nearest(flat: np.ndarray, short: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of every part, by its block's shortlist; only blocks that have one are looked at."""
    n, blocks = len(flat), len(short)
    # differences of numbers up to 4096 have squares that add up to less than 2**31 over 16 components
    small = flat.shape[1] <= 16 and max(np.abs(flat).max(initial=0), np.abs(entries).max(initial=0)) <= 4096
    kind = np.int32 if small else np.int64
    padded = np.zeros((blocks * BLOCK, flat.shape[1]), dtype=kind)
    padded[:n] = flat
    padded = padded.reshape(blocks, BLOCK, -1)
    best = np.full((blocks, BLOCK), np.iinfo(kind).max, dtype=kind)
    chosen = np.zeros((blocks, BLOCK), dtype=np.int32)
    for k in np.flatnonzero(short.any(axis=0)).tolist():
        at = np.flatnonzero(short[:, k])
        gap = padded[at] - entries[k].astype(kind)
        distance = np.einsum("brj,brj->br", gap, gap)
        closer = distance < best[at]
        best[at] = np.where(closer, distance, best[at])
        chosen[at] = np.where(closer, k, chosen[at])
    return chosen.ravel()[:n], best.ravel()[:n].astype(np.int64)


def _opened(batch: pa.RecordBatch, row: int, parts: int, width: int) -> dict[str, np.ndarray]:
    raw = {name: batch.column(batch.schema.get_field_index(name))[row].as_buffer() for name, _ in _CHUNK_FIELDS}
    kinds = {"order": np.int32, "sums": np.int64}
    shaped = {name: np.frombuffer(x, dtype=kinds.get(name, np.int32)).reshape(parts, -1) for name, x in raw.items()}
    return {name: x if name == "order" else x.reshape(parts, -1, width) for name, x in shaped.items()}


def _summed(books: np.ndarray):
    """From chunks the count and sums of each entry, once per task."""
    parts, size, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, size), dtype=np.int64), np.zeros((parts, size, width), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = _opened(batch, row, parts, width)
                for k in range(parts):
                    flat = chunk["flat"][k]
                    short = shortlists(chunk["low"][k], chunk["high"][k], books[k])
                    alone = short.sum(axis=1) == 1
                    rows = np.minimum(BLOCK, len(flat) - BLOCK * np.arange(len(short)))
                    sure = short[alone].argmax(axis=1)
                    np.add.at(counts[k], sure, rows[alone])
                    np.add.at(sums[k], sure, chunk["sums"][k][alone])
                    open_blocks = np.flatnonzero(~alone)
                    if len(open_blocks):
                        at = (open_blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                        at = at[at < len(flat)]
                        # only the last block can be short, and it stays the last one
                        chosen, _ = nearest(flat[at], short[open_blocks], books[k])
                        counts[k] += np.bincount(chosen, minlength=size)
                        np.add.at(sums[k], chosen, flat[at].astype(np.int64))
        slot = np.flatnonzero(counts.ravel())
        columns = [pa.array(slot.astype(np.int32)), pa.array(counts.ravel()[slot])]
        columns += [pa.array(sums.reshape(-1, width)[slot, j]) for j in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *[f"s{j}" for j in range(width)]])

    return work


def _coded(books: np.ndarray):
    """From chunks a row for each vector."""
    parts, _, width = books.shape
    digits = np.array([f"{k:02x}" for k in range(256)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = _opened(batch, row, parts, width)
                n = chunk["order"].shape[1]
                code, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for k in range(parts):
                    chosen, distance = nearest(chunk["flat"][k], shortlists(chunk["low"][k], chunk["high"][k], books[k]), books[k])
                    code[chunk["order"][k], k] = chosen
                    error[chunk["order"][k]] += distance
                text = np.ascontiguousarray(digits[code]).view(f"<U{2 * parts}").ravel()
                columns = [batch.column(batch.schema.get_field_index(c))[row].values for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text.tolist(), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return work


# The operator ----------------------------------------------------------------------------------


def usable_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """(``id``, ``label``, ``vec`` as doubles) of the rows that take part, and the length of their vectors."""
    rows = table.select(named(id_col).alias("id"), named(label_col).alias("label"), named(vec_col).cast("array<double>").alias("vec"))
    # a null component makes the test null, which coalesce turns into no
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & (F.size("vec") % parts == 0) & finite)
    widths = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 0
    return rows.where(F.size("vec") == width), width


def fit_codebooks(chunks: DataFrame, start: Codebooks, rounds: int) -> Codebooks:
    """The codebooks after so many rounds over the chunks. Nothing but sums of entries reaches the driver."""
    books = start.entries
    parts, size, width = books.shape
    names = [f"s{j}" for j in range(width)]
    schema = ", ".join(["slot int", "n bigint", *[f"{s} bigint" for s in names]])
    for _ in range(rounds):
        summed = chunks.select(*[name for name, _ in _CHUNK_FIELDS]).mapInArrow(_summed(books), schema)
        total = summed.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).toArrow()
        slot, n = total["slot"].to_numpy(), total["n"].to_numpy()
        books = books.reshape(-1, width).copy()
        for j, name in enumerate(names):
            books[slot, j] = total[name].to_numpy() // n
        books = books.reshape(parts, size, width)
    return Codebooks(books)


def vector_codes(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, ``code``, ``error``) of every vector that takes part, and the codebooks (none without vectors).

    ``entries`` is 256 at most, as a code has two hex digits for each part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows, width = usable_vectors(table, id_col, vec_col, label_col, parts)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    if not width:
        return table.sparkSession.createDataFrame([], coded), None
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow()
    seeds = whole_numbers(np.array(first["vec"].to_pylist(), dtype=np.float64), scale).astype(np.int64)
    start = Codebooks(seeds.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy())
    schema = ", ".join([f"id array<{kinds['id']}>", f"label array<{kinds['label']}>", *[f"{n} {t}" for n, t in _CHUNK_FIELDS]])
    chunks = materialise(rows.mapInArrow(_chunked(width, parts, scale), schema), "vector-chunks")
    books = fit_codebooks(chunks, start, rounds)
    return chunks.mapInArrow(_coded(books.entries), coded), books


def compressed_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """(id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``): errors also summed over equal labels, nulls together."""
    codes, books = vector_codes(table, id_col, vec_col, label_col, **settings)
    codes = materialise(codes, "vector-codes")
    sums = codes.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error"))
    joined = codes.join(small_side(sums, MAX_LABELS), F.col("label").eqNullSafe(F.col("same")))
    sha = books.sha256() if books else None
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))
