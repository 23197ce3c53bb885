"""Documents whose sets of word n-grams overlap: MinHash candidates, Bayesian pruning, exact check.

Words are maximal runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
A document is the set of its runs of ``shingle`` words; one with fewer words, but at least one, is the set
of that single shorter run. Two documents are linked if |A and B| >= threshold * |A or B|.

1. Documents with the same words in the same order form a class (a 128-bit hash); only one of each goes on.
2. ``HASHES`` MinHash values; classes that agree in one of the bands meet. Inside such a bucket, values are
   compared a few at a time, and a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold is below ``TOLERANCE``. What survives joins candidate groups.
3. Inside a candidate group all pairs are checked exactly on whole sets of n-grams. Links are counted, and
   only one link for every merge leaves the task, so a group of n near copies never becomes n * n rows.

A link of similarity exactly 0.8 is missed with a probability of about 2e-4 by the bands and 1e-4 by the
pruning; more similar ones practically never. Buckets and groups beyond ``TILE`` rows are dealt over pairs
of tiles.

Null, empty and blank texts link with nothing and keep their own id as class. Rows may repeat an id. Ids
may be null: the smallest id that is not null names the group, null if there is none. Other columns of
the table are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import column, fixed_bytes, runs, text_chunks, tidied
from flowlens.llm.grouping import Merger, components, pair_tiles, sorted_by
from flowlens.runtime import column as named
from flowlens.runtime import materialise, small_side

HASHES, ROWS = 64, 4
BANDS = HASHES // ROWS
STEP = 8
TOLERANCE = 1e-4
TILE = 2048
#: Classes of candidate groups that are broadcast to fetch their texts; more are fetched by a shuffle join.
BROADCAST_ROWS = 200_000

_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, size=1024, dtype=np.uint64) * 2 + 1
_BYTES = _SEEDS[:256]
_PLACES = _SEEDS[256 : 256 + 64]
_SCALES = _SEEDS[512 : 512 + HASHES]
_SHIFTS = _SEEDS[768 : 768 + HASHES]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def joined_words(text: str) -> bytes:
    """The words of a text with one blank between them."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram of texts that have single blanks between words, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = data != 0x20
    new = np.zeros(n + 1, dtype=bool)
    new[offsets[offsets <= n]] = True
    opens = word & (new[:-1] | ~np.concatenate([[False], word[:-1]]))
    closes = word & (new[1:] | ~np.concatenate([word[1:], [False]]))
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, n), out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    m = len(words)
    gram = np.zeros(m, dtype=np.uint64)
    length = np.zeros(m, dtype=np.uint64)
    for j in range(min(size, m)):
        same = doc[j:] == doc[: m - j]
        gram[: m - j] += np.where(same, words[j:] * _PLACES[j], np.uint64(0))
        length[: m - j] += same
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    use = (length == size) | first
    return doc[use], _mixed(gram[use] + length[use] * _BASE)


def _signatures(size: int):
    """Adds the class, the low bytes of the MinHash values and the band keys; none for a text without a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b, _, _ in text_chunks(whole.column(2), 1 << 23):
                batch = whole.slice(a, b - a)
                norm = [joined_words(t or "") for t in batch.column(2).to_pylist()]
                cls = [blake2b(t, digest_size=16).digest() if t else None for t in norm]
                rows, sig, bands = _values(pa.array(norm, pa.binary()).cast(pa.string()), size)
                all_sig, all_bands = [None] * len(norm), [None] * len(norm)
                for k, r in enumerate(rows):
                    all_sig[r], all_bands[r] = sig[k].tobytes(), bands[k]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(cls, pa.binary()),
                        pa.array(all_sig, pa.binary()),
                        pa.array(all_bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "tag", "cls", "sig", "bands"],
                )

    return work


def _values(texts: pa.Array, size: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(rows with a word, low bytes of their MinHash values, their band keys)."""
    rows, sig, bands = [], [], []
    for a, _, data, offsets in text_chunks(texts):
        doc, gram = shingles(data, offsets, size)
        if not len(doc):
            continue
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        values = np.empty((len(starts), HASHES), dtype=np.uint32)
        for k in range(HASHES):
            hashed = ((gram * _SCALES[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32)
            values[:, k] = np.minimum.reduceat(hashed, starts)
        keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            keys = _mixed(keys * _BASE + values[:, r::ROWS].astype(np.uint64) + np.uint64(1))
        rows += (a + doc[starts]).tolist()
        sig += list((values & np.uint32(255)).astype(np.uint8))
        bands += list(_mixed(keys + np.arange(BANDS, dtype=np.uint64) * _PLACES[0]).view(np.int64))
    return rows, sig, bands


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 * STEP ... values compared: fewest equal low bytes that keep a pair.

    The prior of the similarity is uniform; unequal values agree in their low byte once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                out.append(m)
                break
    return out


def _survivors(sig: np.ndarray, i: int, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of ``others`` that may be as similar to row ``i`` as the threshold asks, after stepwise comparison."""
    same = np.zeros(len(others), dtype=np.int64)
    for k, need in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        same += (sig[others, cols] == sig[i, cols]).sum(axis=1)
        stay = same >= need
        if not stay.all():
            others, same = others[stay], same[stay]
            if not len(others):
                break
    return others


def _candidate_links(least: list[int]):
    """In each bucket: links that hold together what the pruning leaves; one link for every merge."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in runs(batches, ["band", "lo", "hi"]):
            large = np.flatnonzero(np.diff(borders) > 1)
            if not len(large):
                continue
            sig, cls, side = fixed_bytes(column(table, "sig"), HASHES), column(table, "cls"), table.column("side").to_numpy()
            two_parts = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            left, right = [], []
            for g in large:
                a, b = int(borders[g]), int(borders[g + 1])
                merger = Merger(b - a)
                own, sides = sig[a:b], side[a:b]
                cross = two_parts[a]
                for i in range(b - a):
                    apart = merger.labels != merger.labels[i]
                    if cross:
                        apart &= sides != sides[i]
                    others = np.flatnonzero(apart)
                    if len(others):
                        merger.link(i, _survivors(own, i, others, least))
                left += [a + i for i, _ in merger.edges]
                right += [a + j for _, j in merger.edges]
            if left:
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(left)), cls.take(pa.array(right))], names=["a", "b"])

    return work


def _checked(size: int, ratio: Fraction):
    """In each candidate group: exact links of every class, and one link for every merge."""
    num, den = ratio.numerator, ratio.denominator

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in runs(batches, ["part", "lo", "hi"]):
            text, cls = column(table, "text"), column(table, "cls")
            copies, side, root = table.column("copies").to_numpy(), table.column("side").to_numpy(), column(table, "root")
            two_parts = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            out_cls, out_other, out_links = [], [], []
            for g in range(len(borders) - 1):
                a, b = int(borders[g]), int(borders[g + 1])
                names = cls.slice(a, b - a).to_pylist()
                roots = root.slice(a, b - a).to_pylist()
                for same in _alike(roots):
                    keep = _first_of_each([names[i] for i in same])
                    rows = np.array([a + same[i] for i in keep])
                    if len(rows) < 2:
                        continue
                    inter, count = overlaps(text.take(pa.array(rows)), size)
                    union = count[:, None] + count[None, :] - inter
                    linked = den * inter >= num * union
                    np.fill_diagonal(linked, False)
                    sides = side[rows]
                    if two_parts[a]:
                        linked &= sides[:, None] != sides[None, :]
                    total = linked @ copies[rows]
                    merger = Merger(len(rows))
                    for i in range(len(rows)):
                        merger.link(i, np.flatnonzero(linked[i] & (merger.labels != merger.labels[i])))
                    own = [names[r - a] for r in rows]
                    out_cls += [own[i] for i in np.flatnonzero(total)] + [own[i] for i, _ in merger.edges]
                    out_other += [None] * int((total > 0).sum()) + [own[j] for _, j in merger.edges]
                    out_links += [int(x) for x in total[total > 0]] + [0] * len(merger.edges)
            if out_cls:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_cls, pa.binary()), pa.array(out_other, pa.binary()), pa.array(out_links, pa.int64())],
                    names=["a", "b", "links"],
                )

    return work


def _alike(values: list) -> list[list[int]]:
    places: dict = {}
    for i, v in enumerate(values):
        places.setdefault(v, []).append(i)
    return list(places.values())


def _first_of_each(values: list) -> list[int]:
    return [places[0] for places in _alike(values)]


def overlaps(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the common n-gram sets of all texts of one task's group, and of each set."""
    docs, grams = [], []
    norm = pa.array([joined_words(t) for t in texts.to_pylist()], pa.binary()).cast(pa.string())
    for a, _, data, offsets in text_chunks(norm):
        doc, gram = shingles(data, offsets, size)
        docs.append(doc + a)
        grams.append(gram)
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((doc, gram))
    doc, gram = doc[order], gram[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])
    doc, gram = doc[new], gram[new]
    count = np.bincount(doc, minlength=len(texts))
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    often = np.diff(np.concatenate([starts, [len(gram)]])) > 1
    shared = np.repeat(often, np.diff(np.concatenate([starts, [len(gram)]])))
    place = np.cumsum(np.concatenate([[0], (gram[shared][1:] != gram[shared][:-1]).astype(np.int64)])) if shared.any() else np.zeros(0, int)
    doc = doc[shared]
    inter = np.zeros((len(texts), len(texts)), dtype=np.int64)
    width = max(1, min(8192, (1 << 22) // len(texts)))
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [lo, lo + width])
        block = np.zeros((len(texts), width), dtype=np.float32)
        block[doc[a:b], place[a:b] - lo] = 1
        inter += (block @ block.T).astype(np.int64)
    np.fill_diagonal(inter, count)
    return inter, count


def _classes(signed: DataFrame) -> DataFrame:
    """A row for each class: the row that stands for it, its number of rows, signature and band keys."""
    rows = signed.where("cls IS NOT NULL").groupBy("cls", "id", "tag")
    rows = rows.agg(F.count("*").alias("n"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", "n"))
    return (
        rows.groupBy("cls")
        .agg(first.alias("f"), F.sum("n").alias("copies"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
        .select("cls", F.col("f.id").alias("rep"), F.col("f.tag").alias("tag"), F.col("f.n").alias("rep_rows"), "copies", "sig", "bands")
    )


def class_table(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows: id, tag and class of every text, classes: cls, rep, tag, rep_rows, n_links, class_id, keeper).

    The tag is a hash of the text; with it, rows are found again whose ids are null or repeat. The class of
    a text without a word is null.
    """
    texts = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("tag"), named(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = materialise(
        texts.mapInArrow(tidied(_signatures(shingle)), f"id {kind}, tag bigint, cls binary, sig binary, bands array<bigint>"), "signatures"
    )
    classes = materialise(_classes(signed), "classes")
    least = least_matches(threshold)
    banded = classes.select(F.explode("bands").alias("band"), "cls", "sig")
    buckets = sorted_by(pair_tiles(banded, ["band"], "cls", TILE), ["band", "lo", "hi"])
    found = buckets.select("band", "lo", "hi", "side", "cls", "sig").mapInArrow(tidied(_candidate_links(least)), "a binary, b binary")
    groups = components(found)
    wanted = groups.join(classes.select("cls", "rep", "tag", "copies"), groups["node"] == F.col("cls"))
    wanted = wanted.select("cls", "rep", "tag", "copies", "root", F.xxhash64("root").alias("part"))
    dealt = materialise(pair_tiles(wanted, ["part"], "cls", TILE // 4), "groups")
    g, t = small_side(dealt, BROADCAST_ROWS).alias("g"), texts.alias("t")
    fetched = t.join(g, F.col("t.id").eqNullSafe(F.col("g.rep")) & (F.col("t.tag") == F.col("g.tag")))
    parts = sorted_by(fetched.select("g.*", "t.text"), ["part", "lo", "hi"])
    parts = parts.select("part", "lo", "hi", "side", "cls", "root", "copies", "text")
    checked = materialise(
        parts.mapInArrow(tidied(_checked(shingle, Fraction(str(threshold)))), "a binary, b binary, links bigint"), "checked"
    )
    links = checked.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(checked.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    full = classes.select("cls", "rep", "tag", "rep_rows", "copies").join(links, "cls", "left").join(roots, "cls", "left")
    full = full.withColumn("root", F.coalesce("root", "cls"))
    keeper = full.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cls")).alias("k"))
    full = full.join(keeper, "root").select(
        "cls",
        "rep",
        "tag",
        "rep_rows",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.col("k.rep").alias("class_id"),
        (F.col("k.cls") == F.col("cls")).alias("keeper"),
    )
    return signed.select("id", "tag", "cls"), materialise(full, "classes")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row per document: its id, ``class_id`` (smallest id that links reach), ``n_links`` (documents
    linked directly, copies included) and ``kept`` (its id is ``class_id``)."""
    rows, classes = class_table(docs, id_col, text_col, threshold, shingle)
    found = rows.where("cls IS NOT NULL").join(classes.select("cls", "class_id", "n_links"), "cls")
    alone = rows.where("cls IS NULL").select("id", "id", F.lit(0).cast("bigint"))
    every = found.select("id", "class_id", "n_links").union(alone)
    return every.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of linked ones; texts without a word all stay.

    What happens to the rows of groups is told by a table of ids and text hashes. It is broadcast if small;
    otherwise both sides are shuffled by id.
    """
    rows, classes = class_table(docs, id_col, text_col, threshold, shingle)
    r, c = rows.alias("r"), classes.where("n_links > 0").alias("c")
    stays = F.col("c.keeper") & F.col("r.id").eqNullSafe(F.col("c.rep")) & (F.col("r.tag") == F.col("c.tag"))
    fate = r.join(c, F.col("r.cls") == F.col("c.cls")).select("r.id", "r.tag", stays.alias("stays"), "c.rep_rows").distinct()
    f, d = small_side(materialise(fate, "fate"), BROADCAST_ROWS).alias("f"), docs.withColumn("__tag", F.xxhash64(named(text_col))).alias("d")
    joined = d.join(f, named_in("d", id_col).eqNullSafe(F.col("f.id")) & (F.col("d.__tag") == F.col("f.tag")), "left")
    left = joined.where(F.coalesce(F.col("f.stays"), F.lit(True)))
    left = left.select("d.*", F.when(F.col("f.stays"), F.col("f.rep_rows")).otherwise(F.lit(1)).alias("__rows"))
    once = left.where("__rows = 1").drop("__tag", "__rows")
    again = left.where("__rows > 1").dropDuplicates([id_col, "__tag"]).drop("__tag", "__rows")
    return once.unionByName(again)


def named_in(alias: str, name: str) -> Column:
    return F.col(f"{alias}.`{name.replace('`', '``')}`")
