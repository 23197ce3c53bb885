"""Vector codes, web archives and fill-in-middle against plain versions, on awkward rows."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import fill_middle, vector_codes, warc

# Vector codes ----------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """{(id, vector): ...} the long way: every part against every entry, Python integers."""
    usable = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in usable]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    usable = [r for r in usable if len(r[1]) == width]
    size = width // parts
    whole = [[max(-(2**24), min(2**24, math.floor(256 * x) if abs(256 * x) < 1e18 else int(math.copysign(2**24, x)))) for x in v] for _, v, _ in usable]
    order = sorted(range(len(usable)), key=lambda k: (usable[k][0] is None, usable[k][0] or 0, usable[k][1]))[:entries]
    books = [[whole[k][p * size : (p + 1) * size] for k in order] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [nearest(p, w[p * size : (p + 1) * size])[1] for w in whole]
            for k in range(len(books[p])):
                mine = [w[p * size : (p + 1) * size] for w, c in zip(whole, chosen) if c == k]
                if mine:
                    books[p] = [*books[p][:k], [sum(x) // len(mine) for x in zip(*mine)], *books[p][k + 1 :]]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), w in zip(usable, whole):
        found = [nearest(p, w[p * size : (p + 1) * size]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    return sorted(str((i, code, error, by_label[label], sha)) for i, code, error, label in out)


def got_codes(df, **settings):
    rows = vector_codes.compressed_vectors(df, **settings).collect()
    return sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in rows)


def test_codes_of_awkward_vectors(spark, monkeypatch):
    r = np.random.default_rng(5)
    vectors = [[float(x) for x in np.float32(r.standard_normal(8) * s)] for s in (1, 0.01, 3) for _ in range(60)]
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)] + [(k % 7, vectors[0], None) for k in range(90)]
    rows += [(None, vectors[5], None), (-4, None, 1), (-3, [], 1), (-2, [float("nan")] * 8, 1), (-1, [None] + vectors[0][1:], 1)]
    rows += [(-9, [float("inf")] * 8, 2), (-8, [1.0, 2.0, 3.0], 2), (-7, [0.5] * 16, 2), (500, [0.0] * 8, 1), (501, [-0.0] * 8, 1)]
    rows += [(900 + k, [1e6 * (-1) ** k] * 7 + [3e38], 7) for k in range(3)]
    df = brute.clash(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    want = plain_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], 4, 9, 2)
    assert got_codes(df, parts=4, entries=9) == want
    monkeypatch.setattr(vector_codes, "CHUNK_BYTES", 4 * 8 * 70)
    monkeypatch.setattr(vector_codes, "MAX_LABELS", 1)
    assert got_codes(df.repartition(5), parts=4, entries=9) == want


def test_codes_of_few_and_of_no_vectors(spark):
    rows = [(3, [1.0, -1.0], 1), (1, [1.0, -1.0], 2), (2, [0.2, 5.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert got_codes(df, parts=2) == plain_codes(rows, 2, 64, 2)
    empty = vector_codes.compressed_vectors(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_given_vectors_have_the_plain_codes(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 2 = 0")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    assert got_codes(table) == plain_codes(rows, 16, 64, 2)


def test_shortlists_are_short_and_lose_nothing():
    r = np.random.default_rng(1)
    part = np.floor(40 * r.standard_normal((16_384, 4))).astype(np.int32)
    part = part[np.argsort(vector_codes.hilbert_keys(part))]
    starts = np.arange(0, len(part), vector_codes.BLOCK)
    entries = part[r.choice(len(part), 64, replace=False)].astype(np.int64)
    short = vector_codes.shortlists(np.minimum.reduceat(part, starts), np.maximum.reduceat(part, starts), entries)
    chosen, distance = vector_codes.nearest(part, short, entries)
    gaps = ((part[:, None].astype(np.int64) - entries[None]) ** 2).sum(axis=2)
    assert (chosen == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()
    assert short.mean() < 0.5


def test_a_hilbert_curve_visits_neighbours():
    grid = np.array([(a, b) for a in range(16) for b in range(16)], dtype=np.int32)
    path = grid[np.argsort(vector_codes.hilbert_keys(grid * 64))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# Web archives ----------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def digest_of(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_archive(rows, least=0):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least:
            first[raw] = min(first.get(raw, (True, 0)), (i is None, i or 0))
    out, seen = [], set()
    for i, _, html in rows:
        raw = (html or "").encode()
        response = len(raw) < least or (first[raw] == (i is None, i or 0) and raw not in seen)
        seen.add(raw) if response else None
        to = None if response or first[raw][0] else first[raw][1]
        out.append(str((i, len(raw), digest_of(raw), "response" if response else "revisit", to)))
    return sorted(out)


def got_archive(df, **settings):
    rows = warc.archived_pages(df, **settings).collect()
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows)


def awkward_pages():
    r = random.Random(4)
    long = "".join(r.choice("abcdé日 \r\n") for _ in range(900_000))
    pages = [(k, f"http://a.net/{k}", f"<p>{k % 40}</p>" * (1 + k % 3)) for k in range(400)]
    pages += [(1000 + k, None, None) for k in range(150)] + [(2000, "http://x\r\nEvil: 1", ""), (2001, "", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages += [(7, "http://b", "same"), (7, "http://c", "same"), (7, "http://c", "same"), (None, "http://d", "same"), (3, "u", "same")]
    pages += [(None, None, "only null"), (None, None, "only null"), (5000, "l", long), (4999, "l", long), (5001, "l", long + "x"), (-1, "é ", "é\u0000")]
    return pages


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("least", [0, 10])
def test_archives_of_awkward_pages(spark, monkeypatch, least, small):
    if small:
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5_000)
        monkeypatch.setattr(warc, "SPAN_BYTES", 700)
    rows = awkward_pages()
    df = brute.clash(spark.createDataFrame(rows, PAGES)).repartition(3)
    assert got_archive(df, least=least) == plain_archive(rows, least)


def test_archives_of_no_pages_and_of_other_ids(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.archived_pages(none).count() == 0
    named = spark.createDataFrame([("b c\r\n%", "a"), ("ä", "a"), (None, "b")], "page_id string, html string").withColumn("url", F.lit("u"))
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived_pages(named).collect()}
    assert got == {("b c\r\n%", "response", None), ("ä", "revisit", "b c\r\n%"), (None, "response", None)}


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    rows = awkward_pages()
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    archives = warc.archive_pages(df, str(tmp_path / "w"))
    assert not (tmp_path / "w" / "whole").exists()
    pages = 0
    for r in archives.collect():
        raw = open(r["archive"], "rb").read()
        end = 0
        lines = open(f"{r['archive']}.idx").read().splitlines()
        assert len(lines) == r["records"] and len(raw) == r["bytes"]
        for n, line in enumerate(lines):
            place, offset, size, kind, ident = line.split("\t")
            assert (int(place), int(offset)) == (n, end)
            end += int(size)
            one = zlib.decompressobj(31)
            record = one.decompress(raw[int(offset) : end])
            assert one.eof and not one.unused_data
            assert f"WARC-Type: {kind}\r\n".encode() in record and ident.encode() in record
            assert record.count(b"\r\nEvil") == 0
            pages += kind != "warcinfo"
        assert end == len(raw)
    assert pages == len(rows)
    read = warc.read_archives(archives, str(tmp_path / "w"), payload=True).where("record_type = 'response'")
    assert sorted(x["html"] for x in read.collect()) == sorted({html or "" for _, _, html in rows})


def foreign(k):
    body = f"GET {k}\r\n\r\n".encode() + bytes(range(256)) * k
    return f"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_other_archives_keep_their_records(spark, tmp_path):
    made = [foreign(k) for k in range(60)]
    (tmp_path / "whole.gz").write_bytes(gzip.compress(b"".join(made)))
    (tmp_path / "mixed.gz").write_bytes(gzip.compress(b"".join(made[:7])) + b"".join(gzip.compress(x) for x in made[7:]))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"".join(made))[:-50])
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("whole.gz", "mixed.gz")], "archive string")
    for r in warc.normalise_archives(paths, str(tmp_path / "out")).collect():
        assert r["records"] == 60 and gzip.open(r["archive"]).read() == b"".join(made)
    with pytest.raises(Exception, match="ends inside a"):
        warc.normalise_archives(spark.createDataFrame([(str(tmp_path / "cut.gz"),)], "archive string"), str(tmp_path / "out2"))


# Fill-in-middle ----------------------------------------------------------------------------------


def plain_cut(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def awkward_texts():
    r = random.Random(8)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é日\n\U0001f600\n", "x<P>\ny", "<S>", "a<M", "<\nP>\n<", "<P\n>\nS>", "\r\n\r\n"]
    texts += ["".join(r.choice("a\né<>PSM") for _ in range(r.randrange(1, 60))) for _ in range(150)]
    texts += ["\n" * 200_000, "ab\n" * 70_000, "".join(r.choice("ab\n") for _ in range(150_000)), "é" * 100_000 + "\n" + "x" * 100_000]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(None, "one\ntwo\nthree"), (None, "four\nfive"), (3, "again\nagain"), (3, "again\nagain")]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 100)])
def test_cuts_of_awkward_texts(spark, rate, spm):
    rows = awkward_texts()
    df = brute.clash(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumns({"n": F.lit("extra"), "form": F.lit(1)}).repartition(3)
    cut = fill_middle.fill_in_middle(df, rate=rate, spm=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = [(r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"]) for r in cut.collect()]
    assert sorted(map(str, got)) == sorted(str((i, *plain_cut(i, t, rate=rate, spm=spm), t or "")) for i, t in rows)
    assert {"id", "key", "line", "part"} <= set(cut.columns)
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_the_text_column_may_have_a_result_name(spark):
    df = spark.createDataFrame([("k1", "a\nb\nc")], "n string, output string")
    r = fill_middle.fill_in_middle(df, "n", "output").first()
    assert (r["n"], r["form"], r["output"]) == plain_cut("k1", "a\nb\nc")[:3]


@pytest.mark.parametrize("numbers", [[0], [65_535, 65_536], list(range(70_000)), list(range(3, 200_000, 7)), list(range(0, 200_000, 2)), [5, 6, 7, 70_000, 3_000_000]])
def test_boundary_sets_select_every_number(numbers):
    known = fill_middle.BoundarySet(np.array(numbers))
    step = max(1, len(numbers) // 5_000)
    assert [known.select(k) for k in range(0, len(numbers), step)] == numbers[::step]


def test_all_three_containers_are_used():
    def kind(x):
        return type(fill_middle.BoundarySet(np.array(x)).containers[0]).__name__

    assert kind(list(range(1, 5_000, 3))) == "ArrayContainer"
    assert kind(list(range(1, 60_000, 3))) == "BitmapContainer"
    assert kind(list(range(100, 50_000))) == "RunContainer"
