"""Runs of lines that were already seen: winnowed fingerprints, joined and extended both ways.

Lines are what lies between ``\\n``. Words are counted as maximal runs of anything but blank, tab, line feed,
vertical tab, form feed and carriage return.

* A gram is the shortest run of whole lines from some line on with at least ``GRAM_WORDS`` words.
* A window is the shortest such run with at least ``RUN_WORDS`` words. Of the grams that lie inside it, the
  one with the smallest hash is selected (the last of equal ones). So every repeated run of at least
  RUN_WORDS words has a selected gram at the same place in each of its occurrences.
* Around each selected gram, matches are extended both ways: for each line less than RUN_WORDS words
  away, the run from the gram to that line is a key; so is the gram itself for each line inside it.
* Keys are joined over all documents. A line that some key has at an earlier place (smaller id, then
  smaller hash of the text, then smaller line number) is deleted.

Hence every line of a run of whole lines with at least RUN_WORDS words that occurs earlier is deleted, and
no line is deleted unless it lies in an earlier run of at least GRAM_WORDS words. First occurrences stay,
but a run that overlaps its own repetition (one line many times) keeps its first line only.

Null texts stay null; texts without lines of that size are left as they are. Rows with one id and
one text (told by a 64-bit hash) count as one place, so equal rows are treated alike; other texts of that id, or
of the null id, are places of their own. A null id comes before all others. Keys are 128-bit hashes.
Frequent keys are counted before they are shuffled and their first place is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import tidied
from flowlens.runtime import column as named
from flowlens.runtime import materialise, small_side

GRAM_WORDS = 25
RUN_WORDS = 50
BROADCAST_ROWS = 200_000


def keys_of(text: str, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> Iterator[tuple[bytes, int]]:
    """(key, line number) of every line near a selected gram."""
    lines = [x.encode("utf-8", "surrogatepass") for x in text.split("\n")]
    words = [len(x.split()) for x in lines]
    n = len(lines)
    total = [0] * (n + 1)
    for i, w in enumerate(words):
        total[i + 1] = total[i] + w
    if total[n] < gram_words:
        return
    digests = [blake2b(x, digest_size=16).digest() for x in lines]

    def ends(size: int) -> list[int]:
        """For each line, one past the last line of the shortest run from it with ``size`` words; n + 1 if none."""
        out, e = [], 0
        for i in range(n):
            e = max(e, i + 1)
            while e <= n and total[e] - total[i] < size:
                e += 1
            out.append(e)
        return out

    gram_end, window_end = ends(gram_words), ends(run_words)
    grams: dict[int, bytes] = {}
    waiting: list[int] = []
    selected: set[int] = set()
    head, added = 0, 0
    for i in range(n):
        if window_end[i] > n:
            break
        while added < n and gram_end[added] <= window_end[i]:
            grams[added] = _digest(digests, added, gram_end[added])
            while len(waiting) > head and grams[waiting[-1]] >= grams[added]:
                waiting.pop()
            waiting.append(added)
            added += 1
        while head < len(waiting) and waiting[head] < i:
            head += 1
        if head < len(waiting):
            selected.add(waiting[head])
    for g in sorted(selected):
        e = gram_end[g]
        for line in range(g, e):
            yield grams[g] + b"g%d" % (line - g), line
        line = e
        while line < n and total[line] - total[e] < run_words:
            yield _digest(digests, g, line + 1) + b"r", line
            line += 1
        line = g - 1
        while line >= 0 and total[g] - total[line + 1] < run_words:
            yield _digest(digests, line, e) + b"l", line
            line -= 1


def _digest(digests: list[bytes], a: int, b: int) -> bytes:
    return blake2b(b"".join(digests[a:b]), digest_size=16).digest()


def _emit(gram_words: int, run_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, lines = [], [], []

            def block():
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary()), pa.array(lines, pa.int32())],
                    names=["id", "tag", "key", "line"],
                )

            for n, text in enumerate(batch.column(2)):
                text = text.as_py()
                if not text:
                    continue
                for key, line in keys_of(text, gram_words, run_words):
                    rows.append(n)
                    keys.append(blake2b(key, digest_size=16).digest())
                    lines.append(line)
                if len(rows) > 100_000:
                    yield block()
                    rows, keys, lines = [], [], []
            yield block()

    return work


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(id, tag, lines): sorted numbers of the lines to delete, for every id and hash of a text that has some."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("tag"), named(text_col).alias("text"))
    places = source.mapInArrow(tidied(_emit(gram_words, run_words)), f"id {kind}, tag bigint, key binary, line int")
    place = F.struct("id", "tag", "line")
    firsts = places.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select("key", "first"), "firsts")
    # joined by key at every size: repeated keys grow with the corpus
    later = places.join(firsts, "key").where(~place.eqNullSafe(F.col("first")))
    gone = later.select("id", "tag", "line").distinct().groupBy("id", "tag").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return materialise(gone, "gone")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """All rows and columns with repeated lines cut out of the text, and the numbers of those lines.

    Adds ``removed_lines`` (array of int, empty if none; counted from 0), in place of a column of that name.
    """
    docs = docs.drop("removed_lines")
    gone = small_side(repeated_lines(docs, id_col, text_col, gram_words, run_words), BROADCAST_ROWS)
    gone = gone.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("lines").alias("__lines"))
    text = named(text_col)
    same = docs[f"`{id_col}`"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[f"`{text_col}`"]) == F.col("__tag"))
    joined = docs.join(gone, same, "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("__lines"), i)), "\n")
    joined = joined.withColumn(text_col, F.when(F.col("__lines").isNull(), text).otherwise(left))
    removed = F.coalesce(F.col("__lines"), F.array().cast("array<int>"))
    return joined.withColumn("removed_lines", removed).drop("__id", "__tag", "__lines")
