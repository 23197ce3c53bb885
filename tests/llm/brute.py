"""Plain versions of the operators, and rows that are awkward to them."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["id", "cls", "norm", "size", "cell", "fine", "words", "key", "line", "part", "kept", "rule", "shard", "copy", "place", "score", "pieces", "bits", "node", "root"]


def words(text):
    return WORD.findall(text or "")


def clash(df):
    """The table with further columns named like those that operators use inside."""
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in df.columns])


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def corpus(spark):
    """Nulls everywhere, empty and very long texts, copies, near copies, repeated ids and rows."""
    base = prose(1, 200).split()
    near = list(base)
    near[50] = "changed"
    long = prose(2, 30_000, 5_000)
    lines = "\n".join(prose(k, 30) for k in range(10, 16))
    rows = [
        (1, " ".join(base), "en", "a", 1),
        (2, " ".join(near), "en", "a", 1),
        (3, "  ".join(base), "en", "b", 1),
        (4, None, "en", "a", None),
        (5, "", "fr", None, 0),
        (6, " \t\n ", None, "b", 4),
        (7, long, "en", "c", 1),
        (7, long, "en", "c", 1),
        (8, "one two", "en", "b", 7),
        (9, "one two", "de", "b", 7),
        (10, "x" * 50_000, "en", "c", 50_000),
        (11, lines, "en", "a", 1),
        (12, prose(20, 40) + "\n" + lines + "\n" + prose(21, 40), "en", "b", 1),
        (None, " ".join(near), "en", "a", 1),
        (None, prose(22, 80), None, None, None),
        (13, "Ünï ▁ cödé 日本語\u2003\n\n  two  blanks", "xx", "é", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingle_links(texts, size=5, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return [
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]


def groups_by_links(ids, links):
    """For each row (smallest id that is not null in its group, number of links)."""
    root, count = roots(len(ids), links), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(ids[i], least.get(r, ids[i]))
    return [(ids[i], least.get(root[i]), count[i]) for i in range(len(ids))]
