"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every run of other characters than letters becomes one blank. Its n-grams of
``ORDERS`` characters are hashed into ``BUCKETS`` buckets. Training sums (language, bucket) counts over all
labelled texts; only those sums, at most languages * BUCKETS numbers, are collected. The log-probability
matrix is broadcast, and a batch of texts is scored by gathering the buckets it has.

Result: ``lang_pred``, one of the learned languages, and ``score``, its posterior probability. A null text or
one without a letter gets ``und`` and 0; so does every text when nothing was learned. Ties go to the
first language by code point. Texts are read whole. Training ignores rows with a null language or text.
Ids may be null or repeat; other columns are never read. More than ``MAX_LANGUAGES`` languages raise: the
matrix is broadcast, and a label with that many values is no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import text_chunks
from flowlens.runtime import bounded_rows
from flowlens.runtime import column as named
from flowlens.runtime import materialise

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MAX_LANGUAGES = 500
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 12


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) of every code point; lower cases of several characters are left alone."""
    letter, lower = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.int32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            letter[k] = True
            low = c.lower()
            if len(low) == 1:
                lower[k] = ord(low)
    return letter, lower


def letters_only(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, character) of the texts in lower case with one blank for each run of other characters, one
    before and one behind each text; and whether a text has a letter."""
    letter, lower = _characters()
    parts = [f"\n{t or ''}\n" for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    is_letter = letter[points]
    opens = np.ones(len(points), dtype=bool)
    opens[1:] = is_letter[:-1] | (doc[1:] != doc[:-1])
    keep = is_letter | opens
    chars = np.where(is_letter, lower[points], 0x20)[keep]
    return doc[keep], chars, np.bincount(doc, weights=is_letter, minlength=len(parts)) > 0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram, n-grams of one order after the other; whether a text has a letter."""
    doc, chars, known = letters_only(texts)
    points = chars.astype(np.uint64)
    docs, buckets = [], []
    for n in ORDERS:
        m = max(0, len(points) - n + 1)
        h = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            h = (h + points[j : j + m]) * _MUL
            h ^= h >> np.uint64(29)
        inside = doc[:m] == doc[n - 1 : n - 1 + m]
        docs.append(doc[:m][inside])
        buckets.append((h[inside] >> np.uint64(17)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(docs), np.concatenate(buckets), known


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b, _, _ in text_chunks(texts):
            doc, bucket, known = features(texts.slice(a, b - a).to_pylist())
            names = sorted(set(langs[a:b]))
            code = np.array([names.index(x) for x in langs[a:b]])
            use = known[doc]
            counts = np.bincount(code[doc[use]] * BUCKETS + bucket[use], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, name in enumerate(names):
                totals[name] = totals[name] + counts[k] if name in totals else counts[k]
                texts_of[name] = texts_of.get(name, 0) + int((known & (code == k)).sum())
    for name, row in totals.items():
        used = np.flatnonzero(row)
        # the last bucket number stands for the number of texts
        bucket = np.append(used, BUCKETS).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(np.append(row[used], texts_of[name]))],
            names=["lang", "bucket", "n"],
        )


def train_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, matrix of log probabilities: a row for each bucket, the last row for the priors)."""
    rows = labelled.select(named(lang_col).cast("string").alias("lang"), named(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "counts")
    found = bounded_rows(counted.where((F.col("bucket") == BUCKETS) & (F.col("n") > 0)), MAX_LANGUAGES, "languages")
    priors = {r["lang"]: r["n"] for r in found}
    langs = sorted(priors, key=lambda x: x.encode())
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0), dtype=np.float32)
    matrix, place = np.ones((BUCKETS, len(langs))), {x: k for k, x in enumerate(langs)}
    packed = counted.where(F.col("bucket") < BUCKETS).groupBy("lang", F.expr(f"bucket div {_BLOCK}").alias("block"))
    for row in packed.agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).toLocalIterator():
        if row["lang"] in place:
            matrix[[c["bucket"] for c in row["cells"]], place[row["lang"]]] += [c["n"] for c in row["cells"]]
    logs = np.log(matrix) - np.log(matrix.sum(axis=0))
    prior = np.log([priors[x] for x in langs]) - np.log(sum(priors.values()))
    return langs, np.vstack([logs, prior[None, :]]).astype(np.float32)


def detect_language(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(langs)))
            known = np.zeros(batch.num_rows, dtype=bool)
            for a, b, _, _ in text_chunks(batch.column(1)) if langs else []:
                doc, bucket, known[a:b] = features(batch.column(1).slice(a, b - a).to_pylist())
                for k in range(len(langs)):
                    sums[a:b, k] = np.bincount(doc, weights=logs[bucket, k], minlength=b - a)
            sums += logs[-1] if langs else 0
            best = np.full(batch.num_rows, len(langs))
            posterior = np.zeros(batch.num_rows)
            if langs:
                top = sums.argmax(axis=1)
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                best = np.where(known, top, best)
                posterior = np.where(known, 1 / odds.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(posterior)], names=["id", "lang_pred", "score"]
            )

    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
