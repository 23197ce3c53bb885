"""Quality of a text by its perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model of order ``ORDER`` over UTF-16 code units: a symbol is a character, or half of one
beyond U+FFFF. Four units are one 64-bit number, so every n-gram is known exactly, there is no fixed alphabet, and the tables
grow with the trusted text. Counts are summed over all trusted text, sharded by n-gram; continuation counts, discounts, context
totals and probabilities follow from joins of the sharded tables on contexts and suffixes. Symbols that trusted text lacks share
one further symbol in the uniform distribution at the bottom.

Texts are scored by joins with the sharded tables; nothing of them is broadcast or reaches the driver but a few sums. Rows
are packed into chunks of about ``CHUNK_BYTES`` of text and written once, in buckets by chunk, so the packed texts are never shuffled. A chunk asks for each of its distinct n-grams a single
time, whatever the number of documents and repeats that hold it; the answers (probability, and weight as a context) meet
the rows of the chunk again by its number, and each document sums its own bits. A common n-gram is asked for once a
chunk, so no key is hotter than the number of chunks, and copies of a text lie in the chunks of the tasks that read them.

A text is kept if its bits per symbol do not exceed the threshold of its language: with the quantiles
q50 and q95 of trusted texts of that language, q95 + SLACK * (q95 - q50). Short texts scatter more, so
``SHORT`` * (q95 - q50) / sqrt(symbols) is added. Languages without trusted texts, and null ones, take the
quantiles of all trusted texts. Without any trusted text everything with a symbol is kept.

Null and empty texts have no perplexity and are rejected. Ids may be null or repeat; a label counts as trusted
if all its rows with that id have the trusted value. Texts are scored whole; a longer text than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.batches import column, text_chunks, tidied, tidied_groups
from flowlens.runtime import column as named
from flowlens.runtime import bucketed, materialise, small_side

ORDER, BITS = 4, 16
SLACK = 2.0
SHORT = 40.0
#: Text that asks for its n-grams together, and text of one packed row.
CHUNK_BYTES, PACK_BYTES = 32 << 20, 1 << 20
#: Level of its compression: 1 leaves 11.7 MB of the documents of sf0.1, 3 leaves 10.2, 6 leaves 9.5 in 2.6 times the time of 3.
PACK_LEVEL = 3
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1 << 21
#: Bits per symbol are binned this fine for the quantiles.
BINS = 1000
BROADCAST_ROWS = 500_000
_NEWLINE = 10


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of UTF-8 bytes, and the offsets of the texts in units. Broken bytes count as U+FFFD."""
    try:
        every = data.tobytes().decode().encode("utf-16-le")
        size = ((data & 0xC0) != 0x80) + (data >= 0xF0).astype(np.int64)
        return np.frombuffer(every, dtype="<u2").astype(np.int64), np.concatenate([[0], np.cumsum(size)])[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace").encode("utf-16-le") for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer(b"".join(texts), dtype="<u2").astype(np.int64), np.concatenate([[0], np.cumsum([len(t) // 2 for t in texts])])


def grams(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol, the last symbol in the lowest bits; a text starts as if after line ends."""
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = symbols.copy()
    for j in range(1, ORDER):
        before = np.full(len(symbols), _NEWLINE, dtype=np.int64)
        before[j:] = symbols[:-j] if j < len(symbols) else before[j:]
        before[place < j] = _NEWLINE
        out |= before << (BITS * j)
    return out


def suffix_of(gram, order: int):
    """The last ``order`` symbols."""
    return gram & ((1 << (BITS * order)) - 1)


def context_of(gram, order: int):
    """All symbols but the last of an n-gram of ``order``."""
    return suffix_of(gram >> BITS, order - 1)


def _distinct(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of pieces of the texts, and how often each is there."""
    for _, _, data, offsets in text_chunks(texts):
        if len(data):
            yield np.unique(grams(*units(data, offsets)), return_counts=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for found in _distinct(batch.column(0)):
            held.append(found)
            size += len(found[0])
            if size > HELD:
                yield from _summed(held)
                held, size = [], 0
    if held:
        yield from _summed(held)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    every, places = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    n = np.bincount(places, weights=np.concatenate([n for _, n in held])).astype(np.int64)
    for a in range(0, len(every), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(every[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["gram", "n"])


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams counted once, twice and more often, from the counts of counts."""
    found = counts.agg(*[F.sum((F.col("n") == k).cast("bigint")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [float(found[f"n{k}"] or 0) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), raw))


@dataclass
class Model:
    """``table`` holds (k, gram, bits, weight) of n-grams of k symbols: -log2 of the probability of a seen one, and of the weight that
    it gives, as a context, to the next lower order; either may be null. ``unseen`` are the bits of a symbol that was never seen, without context."""

    table: DataFrame
    unseen: float


def _shorter(name: str, order: int):
    return F.col(name).bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def train(trusted: DataFrame, text_col: str = "text") -> Model | None:
    """Fit on the texts of ``trusted``; None if they have no symbol."""
    texts = trusted.select(named(text_col).alias("text"))
    counts = texts.mapInArrow(tidied(_counted), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    by_order = {ORDER: materialise(counts, "counts")}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = materialise(by_order[k + 1].groupBy(_shorter("gram", k).alias("gram")).agg(F.count("*").alias("n")), "counts")
    known = by_order[1].count()
    if not known:
        return None
    none = F.lit(None).cast("double")
    every, lower, unseen = None, None, 0.0
    for k in range(1, ORDER + 1):
        d = discounts(by_order[k])
        discount = F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        context = F.shiftrightunsigned("gram", BITS).alias("context")
        rows = by_order[k].select("gram", context, _shorter("gram", k - 1).alias("suffix"), "n", discount.alias("d"))
        sums = [F.sum("n").alias("total"), F.sum("d").alias("freed")]
        if k == 1:
            found = rows.agg(*sums).first()
            unseen = found["freed"] / found["total"] / (known + 1)
            p = rows.select("gram", ((F.col("n") - F.col("d")) / F.lit(float(found["total"])) + F.lit(unseen)).alias("p"))
        else:
            contexts = materialise(rows.groupBy("context").agg(*sums), "contexts")
            weight = (F.col("freed") / F.col("total")).alias("weight")
            every = every.union(contexts.select(F.lit(k - 1).alias("k"), F.col("context").alias("gram"), none.alias("p"), weight))
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            p = rows.join(contexts, "context").join(below, "suffix")
            p = p.select("gram", ((F.col("n") - F.col("d") + F.col("freed") * F.col("lower")) / F.col("total")).alias("p"))
        lower = materialise(p, "probabilities")
        own = lower.select(F.lit(k).alias("k"), "gram", "p", none.alias("weight"))
        every = own if every is None else every.union(own)
    bits = [(-F.log2(F.max(c))).cast("float").alias(name) for c, name in (("p", "bits"), ("weight", "weight"))]
    return Model(materialise(every.groupBy("k", "gram").agg(*bits), "model"), float(-np.log2(unseen)))


def _packed(text_col: str):
    """Rows as compressed Arrow streams of about PACK_BYTES of text, numbered by chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=PACK_LEVEL))
        for batch in batches:
            for a, b, data, _ in text_chunks(column(pa.Table.from_batches([batch]), text_col), PACK_BYTES):
                if size and size + len(data) > CHUNK_BYTES:
                    chunk, size = chunk + 1, 0
                size += len(data)
                sink = pa.BufferOutputStream()
                # a slice is written with its own rows only
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                packed = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), packed], names=["chunk", "rows"])

    return work


def _unpacked(rows: pa.Array) -> Iterator[pa.RecordBatch]:
    for packed in rows:
        yield from pa.ipc.open_stream(packed.as_buffer())


def _asked(text_col: str):
    """The distinct n-grams of each chunk, of all orders."""

    def told(chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        wanted = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        for k in range(ORDER, 0, -1):
            for a in range(0, len(wanted), 100_000):
                part = wanted[a : a + 100_000]
                same = [pa.array(np.full(len(part), v, dtype=t)) for v, t in ((k, np.int32), (chunk, np.int64))]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(part), same[1]], names=["k", "gram", "chunk"])
            wanted = np.unique(np.concatenate([suffix_of(wanted, k - 1), context_of(wanted, k)]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk != current:
                    yield from told(current, held)
                    current, held = chunk, []
                for rows in _unpacked(batch.column("rows").slice(i, 1)):
                    held.extend(g for g, _ in _distinct(column(pa.Table.from_batches([rows]), text_col)))
        yield from told(current, held)

    return work


def _bits(grams_: np.ndarray, answers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], unseen: float) -> np.ndarray:
    """Bits of each symbol: those of the longest n-gram that was seen, plus the weights of the contexts passed on the way."""
    total, left = np.zeros(len(grams_)), np.arange(len(grams_))

    def found(k: int, column_: int, wanted: np.ndarray) -> np.ndarray:
        keys = answers[k][0]
        if not len(keys):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, answers[k][column_][at], np.nan)

    for k in range(ORDER, 0, -1):
        wanted = suffix_of(grams_[left], k) if k < ORDER else grams_
        got = found(k, 1, wanted)
        seen = ~np.isnan(got)
        total[left[seen]] += got[seen]
        left, wanted = left[~seen], wanted[~seen]
        if k > 1:
            total[left] += np.nan_to_num(found(k - 1, 2, context_of(wanted, k)))
    total[left] += unseen
    return total


def _scoring(text_col: str, unseen: float):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        orders, every = right.column("k").to_numpy(), right.column("gram").to_numpy()
        values = [right.column(c).to_numpy().astype(np.float32) for c in ("bits", "weight")]
        answers = {}
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(orders == k)
            at = at[np.argsort(every[at])]
            answers[k] = (every[at], *[v[at] for v in values])
        out = []
        for rows in _unpacked(left.column("rows").combine_chunks()):
            size, total = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows)
            for a, b, data, offsets in text_chunks(column(pa.Table.from_batches([rows]), text_col)):
                if len(data):
                    symbols, places = units(data, offsets)
                    size[a:b] = np.diff(places)
                    doc = np.repeat(np.arange(b - a), size[a:b])
                    total[a:b] = np.bincount(doc, weights=_bits(grams(symbols, places), answers, unseen), minlength=b - a)
            mean = pa.array(np.round(total / np.maximum(size, 1), 6), mask=size == 0)
            out.append(pa.RecordBatch.from_arrays([*rows.columns, pa.array(size), mean], names=[*rows.schema.names, "n_symbols", "bits"]))
        return pa.Table.from_batches(out)

    return work


def scored(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_symbols`` and ``bits`` (per symbol; null without symbols or model)."""
    size = F.floor(F.octet_length(F.encode(named(text_col), "UTF-16LE")) / 2).cast("bigint")
    blank = docs.select("*", F.coalesce(size, F.lit(0).cast("bigint")).alias("n_symbols"), F.lit(None).cast("double").alias("bits"))
    if model is None:
        return blank
    packs = bucketed(docs.mapInArrow(tidied(_packed(text_col)), "chunk bigint, rows binary"), "chunk", "packs")
    asked = packs.mapInArrow(tidied(_asked(text_col)), "k int, gram bigint, chunk bigint")
    answers = asked.join(model.table, ["k", "gram"]).select("chunk", "k", "gram", "bits", "weight")
    return packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidied_groups(_scoring(text_col, model.unseen)), blank.schema)


def language_limits(trusted: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(lang, q50, q95) of trusted, scored texts, exact over bins; a row with null language for all together."""
    bins = trusted.where("bits IS NOT NULL").select(named(lang_col).alias("lang"), F.floor(F.col("bits") * BINS).alias("bin"))
    counts = bins.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    every = counts.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    both = counts.where("lang IS NOT NULL").select("lang", "bin", "n").union(every)
    w = Window.partitionBy("lang").orderBy("bin")
    ranked = both.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))

    def quantile(share: float):
        return F.min(F.when(F.col("upto") >= F.col("total") * F.lit(share), (F.col("bin") + 1) / F.lit(float(BINS))))

    return ranked.groupBy("lang").agg(quantile(0.5).alias("q50"), quantile(0.95).alias("q95"))


def judge_perplexity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     label_id: str = "doc_id", label_col: str = "quality", trusted_value: int = 1) -> DataFrame:
    """All columns of ``docs`` with ``n_symbols``, ``perplexity``, ``threshold`` (a perplexity) and ``kept``.

    Columns of ``docs`` with these names are replaced.
    """
    label = labels.select(named(label_id).alias("__id"), (named(label_col) == F.lit(trusted_value)).alias("__good"))
    label = label.where("__id IS NOT NULL").groupBy("__id").agg(F.min(F.coalesce("__good", F.lit(False))).alias("__good"))
    label = small_side(label.where("__good").select("__id"), BROADCAST_ROWS)
    trusted = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    # read twice, as written once it would take as much disk as its packs
    trusted = trusted.join(label, F.col("id") == F.col("__id"), "left_semi").select("text", "lang")
    model = train(trusted)
    limits = materialise(language_limits(materialise(scored(trusted, model).select("lang", "bits"), "trusted_bits")), "limits")
    every = limits.where("lang IS NULL").first()
    one = small_side(limits.where("lang IS NOT NULL"), BROADCAST_ROWS).alias("l")
    docs = docs.drop("n_symbols", "bits", "perplexity", "threshold", "kept")
    found = scored(docs, model, text_col).alias("d").join(one, named_in("d", lang_col) == F.col("l.lang"), "left")
    q50, q95 = (F.coalesce(f"l.{q}", F.lit(every[q] if every else None).cast("double")) for q in ("q50", "q95"))
    limit = q95 + (q95 - q50) * (F.lit(SLACK) + F.lit(SHORT) / F.sqrt(F.greatest(F.col("d.n_symbols"), F.lit(1))))
    kept = (F.col("d.n_symbols") > 0) & F.coalesce(F.col("d.bits") <= limit, F.lit(True))
    return found.select("d.*", F.pow(F.lit(2.0), "d.bits").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), kept.alias("kept")).drop("bits")


def named_in(alias: str, name: str):
    return F.col(f"{alias}.`{name.replace('`', '``')}`")
