"""Allow and block rules on hosts and paths of URLs, by a sorted sweep.

A rule is a host and a path prefix, written ``host/path``. It fits a URL whose host is the rule's or one of
its subdomains and whose path starts with the rule's. The longest fitting rule decides; of equally long
ones the first by code point. A URL that no rule fits gets the default verdict.

A host becomes a key with its labels in reverse, each closed by a slash (``a.b.net`` is ``net/b/a/``), which no
host can hold, so that a rule's hosts are the interval of keys that start with its own. Rules and URLs are cut at the same
keys, URLs of one host may be cut among several parts, and a rule goes to each part its interval meets.
Each part is sorted and read once: rules of enclosing hosts wait on a stack until a key lies beyond their
interval, and a URL looks only at the stack. Between two tasks nothing is needed. The cuts come from a
bounded sample of keys; they decide where a row is read, never what it gets.

A URL that is null or has no ``://`` has an empty host and path and gets the default. Rules with a null
part or without a host are ignored; a repeated rule counts once, and of opposite verdicts for one rule the smaller word
(allow) holds. Ids may be null or repeat: every row is judged. Other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column as named


#: Keys looked at for each cut.
SAMPLE_PER_CUT = 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels in reverse, each closed by a slash; empty for an empty host."""
    reverse = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))
    return F.when(host == "", F.lit("")).otherwise(reverse)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has ``rule`` (``host/path``) and ``verdict``.
    """
    spark = pages.sparkSession
    urls = pages.select(named(id_col).alias("id"), host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("spread", F.xxhash64("key", "path", "id"))
    known = rules.where("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    known = known.withColumn("host", F.substring_index("rule", "/", 1))
    known = known.withColumn("path", F.expr("substring(rule, length(host) + 1)")).withColumn("key", host_key(F.col("host")))
    known = known.where("key <> ''")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = urls.select("key", "spread").orderBy(F.xxhash64("spread")).limit(parts * SAMPLE_PER_CUT).collect()
    places = sorted((r["key"].encode(), r["spread"]) for r in sample)
    cuts = sorted({places[k * len(places) // parts] for k in range(1, parts)}) if places else []
    kind = pages.schema[id_col].dataType
    none = F.lit(None).cast("string")
    opened = known.select("key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("spread"), F.lit(None).cast(kind).alias("id"), "host", "path", "rule", "verdict")
    points = urls.select("key", F.lit(1).alias("kind"), "spread", "id", "host", "path", none.alias("rule"), none.alias("verdict"))
    schema = f"part int, key string, kind int, id {kind.simpleString()}, host string, path string, rule string, verdict string"
    placed = opened.unionByName(points).mapInArrow(_placed(cuts), schema)
    swept = placed.repartition("part").sortWithinPartitions("part", "key", "kind")
    judged = swept.mapInArrow(_sweep(default), f"id {kind.simpleString()}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_col)


def _placed(cuts: list[tuple[bytes, int]]):
    """Adds the part: the number of cuts that are not beyond a row. A rule is repeated for each part of its interval."""
    last = b"\xff"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            d = {name: batch.column(name).to_pylist() for name in ("key", "kind", "spread")}
            for n, (key, kind, spread) in enumerate(zip(d["key"], d["kind"], d["spread"])):
                key = key.encode()
                first = bisect_right(cuts, (key, spread if kind else -(1 << 63)))
                for part in [first] if kind else range(first, bisect_right(cuts, (key + last, 0)) + 1):
                    rows.append(n)
                    parts.append(part)
            took = batch.take(pa.array(rows, pa.int64()))
            names = ["key", "kind", "id", "host", "path", "rule", "verdict"]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *[took.column(n) for n in names]], names=["part", *names])

    return work


def _sweep(default: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            d = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names) if name != "id"}
            points, rule, verdict = [], [], []
            for n, here in enumerate(d["part"]):
                if here != part:
                    part, stack = here, []
                key = d["key"][n]
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                path = d["path"][n]
                if d["kind"][n] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, d["rule"][n], d["verdict"][n]))
                    continue
                fits = [(-len(r), r, v) for _, rules in stack for p, r, v in rules if path.startswith(p)]
                best = min(fits) if fits else (0, None, default)
                points.append(n)
                rule.append(best[1])
                verdict.append(best[2])
            took = batch.take(pa.array(points, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [took.column("id"), took.column("host"), took.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return work
