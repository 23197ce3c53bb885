"""Operators on documents against plain versions, on awkward and on given rows."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import jaccard, kneser_ney, language, line_dedup, mixing, pieces, quality_votes, secrets
from flowlens.llm.queries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def corpus(spark):
    return brute.clash(brute.corpus(spark)).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(corpus):
    return corpus.limit(0)


def key(rows):
    return sorted(rows, key=str)


# near copies


def test_similar_documents_equal_all_pairs(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    want = brute.groups_by_links([r[0] for r in rows], brute.shingle_links([r[1] for r in rows]))
    alone = {i for i, (_, t) in enumerate(rows) if not brute.words(t)}
    want = [(i, i, 0) if n in alone else (i, c, k) for n, (i, c, k) in enumerate(want)]
    got = jaccard.similar_documents(corpus).collect()
    assert key((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == key(want)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_similar_documents_of_the_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute.groups_by_links([r[0] for r in rows], brute.shingle_links([r[1] for r in rows]))
    got = QUERIES["op3_ngram_jaccard_join"](spark, sf_dir).collect()
    assert key((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == key(want)


def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 64)
    base = brute.prose(5, 120).split()
    rows = []
    for i in range(150):
        own = list(base)
        own[(7 * i) % 120] = f"own{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.groups_by_links([r[0] for r in rows], brute.shingle_links([r[1] for r in rows]))
    got = jaccard.similar_documents(docs).collect()
    assert key((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == key(want)


def test_one_document_of_each_group_stays(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    root = brute.roots(len(rows), brute.shingle_links([r[1] for r in rows]))
    got = jaccard.one_of_each(corpus)
    assert got.columns == corpus.columns
    assert got.count() == len(set(root))
    assert {1, 4, 5, 6, 7, 8} <= {r["doc_id"] for r in got.collect()}


def test_pruning_bounds_rise_with_the_values_compared():
    least = jaccard.least_matches(0.8)
    assert len(least) == jaccard.HASHES // jaccard.STEP and least == sorted(least)
    # a pair at the threshold passes all comparisons nearly always
    r = np.random.default_rng(1)
    same = (r.random((20_000, jaccard.HASHES)) < 0.8).cumsum(axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (same >= np.array(least)).all(axis=1).mean() > 0.999


# repeated lines


def _expected_removals(rows, gram=line_dedup.GRAM_WORDS, run=line_dedup.RUN_WORDS):
    """Plain selection, keys as tuples of lines, first places by a scan."""
    keys = []
    for doc, text in rows:
        lines = (text or "").split("\n") if text else []
        count = [len(brute.words(x)) for x in lines]

        def shortest(a, size):
            for b in range(a + 1, len(lines) + 1):
                if sum(count[a:b]) >= size:
                    return b
            return None

        chosen = set()
        for i in range(len(lines)):
            end = shortest(i, run)
            if end is None:
                break
            inside = [g for g in range(i, end) if shortest(g, gram) is not None and shortest(g, gram) <= end]
            digests = {g: next(iter(_gram(lines, g, shortest(g, gram)))) for g in inside}
            best = min(digests.values())
            chosen.add(max(g for g in inside if digests[g] == best))
        for g in chosen:
            e = shortest(g, gram)
            keys += [((tuple(lines[g:e]), "g", x - g), doc, x) for x in range(g, e)]
            x = e
            while x < len(lines) and sum(count[e:x]) < run:
                keys.append(((tuple(lines[g : x + 1]), "r"), doc, x))
                x += 1
            x = g - 1
            while x >= 0 and sum(count[x + 1 : g]) < run:
                keys.append(((tuple(lines[x:e]), "l"), doc, x))
                x -= 1
    order = lambda d, x: (d is not None, d or 0, x)
    first = {}
    for k, d, x in keys:
        first[k] = min(first.get(k, order(d, x)), order(d, x))
    return {(d, x) for k, d, x in keys if order(d, x) != first[k]}


def _gram(lines, a, b):
    raw = [line_dedup.blake2b(x.encode(), digest_size=16).digest() for x in lines]
    yield line_dedup._digest(raw, a, b)


@pytest.mark.parametrize("source", ["awkward", "given"])
def test_removed_lines_equal_the_plain_rule(spark, sf_dir, corpus, source):
    docs = corpus if source == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = _expected_removals([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert {(r["doc_id"], x) for r in got for x in r["removed_lines"]} == want
    assert len(got) == docs.count() and want


def test_every_repeated_run_of_fifty_words_goes_and_first_ones_stay(spark):
    run = "\n".join(brute.prose(k, 11, 10_000) for k in range(5))
    rows = [(k, brute.prose(100 + k, 60, 10_000) + "\n" + run + "\n" + brute.prose(200 + k, 9, 10_000)) for k in range(6)]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0]["removed_lines"] == [] and got[0]["text"] == rows[0][1]
    for k in range(1, 6):
        assert got[k]["removed_lines"] == [1, 2, 3, 4, 5]
        assert got[k]["text"] == "\n".join([rows[k][1].split("\n")[0], rows[k][1].split("\n")[-1]])


def test_line_dedup_leaves_null_and_small_texts(corpus):
    got = line_dedup.drop_repeated_lines(corpus).where("doc_id in (4, 5, 6, 8, 9)").collect()
    assert len(got) == 5 and all(r["removed_lines"] == [] for r in got)


@pytest.mark.parametrize("shared", [None, 5])
def test_rows_of_one_id_lose_only_lines_of_their_own_text(spark, shared):
    run = [brute.prose(k, 11, 10_000) for k in range(300, 305)]
    own = [[brute.prose(400 + 20 * j + k, 11, 10_000) for k in range(8)] for j in range(4)]
    texts = {"repeats": own[0][:2] + run + own[0][2:], "clean": own[1], "same place": own[2][:2] + run + own[2][2:]}
    rows = [(shared, "\n".join(x)) for x in texts.values()]
    got = [r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert "\n".join(own[1]) in got
    assert len(got) == 3 and sum("\n".join(run) in t for t in got) == 1
    cut = {"\n".join(own[0]), "\n".join(own[2])}
    assert len(cut & set(got)) == 1


# mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > most * sizes[s]]
        if not above:
            return capped | {s: weight[s] * level for s in free}
        capped |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("source", ["awkward", "given"])
def test_mix_meets_its_targets(spark, sf_dir, corpus, source):
    docs = corpus if source == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = _targets(sizes)
    got = mixing.mix_sizes(docs)
    both = got.join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert got.count() == len(rows)
    taken, largest = {}, {}
    for r in both:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in taken:
        if s is not None and source == "given":
            assert abs(taken[s] - want[s]) <= max(largest[s], 0.01 * want[s])


def test_mix_is_the_same_again_and_on_other_layouts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = mixing.mix_sizes(docs).select("doc_id", "shards").collect()
    again = mixing.mix_sizes(docs.repartition(5)).select("doc_id", "shards").collect()
    assert key(first) == key(again)


def test_shards_have_equal_numbers_of_blocks(spark):
    slots = spark.range(1000).select(
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), F.col("id").cast("int").alias("block"), F.lit(0).alias("copy")
    )
    dealt = mixing._dealt(slots, 8, 3)
    assert [r["count"] for r in dealt.groupBy("shard").count().collect()] == [125] * 8
    assert dealt.select("source", "block", "copy").distinct().count() == 1000


def test_rows_lie_in_their_shards_in_random_order(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 1000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planned = QUERIES["op5_mixing_sources"](spark, sf_dir)
    _, blocks = mixing.mix_plan(docs, "doc_id", "text", "source")
    slots = {r["shard"]: r["count"] for r in blocks.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect()}
    assert sorted(slots) == list(range(mixing.SHARDS)) and max(slots.values()) - min(slots.values()) <= 1
    rows = mixing.mixed_documents(docs).select(F.spark_partition_id().alias("part"), "shard", "place", "copy", "doc_id").collect()
    want = planned.select("doc_id", F.posexplode("shards").alias("copy", "shard")).collect()
    assert key((r["doc_id"], r["copy"], r["shard"]) for r in rows) == key(tuple(r) for r in want)
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r)
    per_shard = -(-planned.agg(F.sum("size")).first()[0] // (mixing.SHARDS * 1000))
    assert per_shard > 1 and all({r["part"] // per_shard for r in rows if r["shard"] == s} == {s} for s in slots)
    assert all([r["place"] for r in part] == sorted(r["place"] for r in part) for part in parts.values())


def test_mixed_documents_repeat_whole_rows(spark, corpus):
    mixed = mixing.mixed_documents(corpus)
    sizes = {tuple(r): r["n"] for r in mixed.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    want = mixing.mix_sizes(corpus).agg(F.sum(F.size("shards"))).first()[0]
    assert sum(sizes.values()) == want
    assert sorted(mixed.columns) == sorted(corpus.columns)


# language


def test_language_of_held_out_documents(spark, sf_dir):
    got = QUERIES["op4_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id")
    assert held.count() and held.where("lang <> lang_pred").count() <= 0.05 * held.count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_equals_naive_bayes_by_dictionaries(spark):
    train = [("aa bb", "x"), ("ab ba", "x"), ("cc dd c", "y"), (None, "y"), ("zz", None), ("", "x")]
    langs, matrix = language.train_languages(spark.createDataFrame(train, "text string, lang string"))
    counts = {l: np.ones(language.BUCKETS) for l in langs}
    for t, l in train:
        if t and l:
            np.add.at(counts[l], language.features([t])[1], 1)
    for k, l in enumerate(langs):
        assert np.allclose(matrix[:-1, k], np.log(counts[l] / counts[l].sum()), atol=1e-5)
    assert np.allclose(np.exp(matrix[-1]), [2 / 3, 1 / 3], atol=1e-5)


def test_texts_become_letters_with_single_blanks():
    doc, chars, known = language.letters_only(["Äb  1c!", None, "", "7", "é"])
    text = {k: "".join(map(chr, chars[doc == k])) for k in range(5)}
    assert text == {0: " äb c ", 1: " ", 2: " ", 3: " ", 4: " é "} and known.tolist() == [True, False, False, False, True]


def test_language_of_awkward_rows(spark, corpus, empty):
    langs, matrix = language.train_languages(corpus)
    got = language.detect_language(corpus, langs, matrix).collect()
    assert len(got) == corpus.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (4, 5, 6))
    assert all(r["lang_pred"] in langs for r in got if r["doc_id"] in (1, 7, 10, 13))
    langs, matrix = language.train_languages(empty)
    assert langs == [] and {r["lang_pred"] for r in language.detect_language(corpus, langs, matrix).collect()} == {"und"}


# perplexity


def _plain_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: a function from n-gram to probability."""
    n = kneser_ney.ORDER
    counts = [dict() for _ in range(n + 1)]
    for t in texts:
        s = "\n" * (n - 1) + (t or "")
        for i in range(n - 1, len(s)):
            counts[n][s[i - n + 1 : i + 1]] = counts[n].get(s[i - n + 1 : i + 1], 0) + 1
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def cut(k):
        c = [sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        raw = [j - (j + 1) * y * c[j] / c[j - 1] if c[j - 1] else j / 2 for j in (1, 2, 3)]
        return [min(max(d, 0.1), j - 0.1) for j, d in zip((1, 2, 3), raw)]

    d = [None] + [cut(k) for k in range(1, n + 1)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        seen = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not seen:
            return lower
        total = sum(seen.values())
        freed = sum(d[k][min(c, 3) - 1] for c in seen.values())
        own = max(seen.get(g, 0) - (d[k][min(seen[g], 3) - 1] if g in seen else 0), 0)
        return own / total + freed / total * lower

    return p


def _halved(text):
    """Characters beyond U+FFFF as two."""
    data = (text or "").encode("utf-16-le")
    return "".join(chr(data[i] + 256 * data[i + 1]) for i in range(0, len(data), 2))


def _plain_bits(p, text):
    s = "\n" * (kneser_ney.ORDER - 1) + text
    return [-math.log2(p(s[i : i + kneser_ney.ORDER])) for i in range(len(text))]


OTHER_SCRIPTS = ["Быстрая лиса прыгает через ленивую собаку", "γρήγορη αλεπού πηδάει", "敏捷的狐狸跳过懒狗。敏捷的狐狸", "الثعلب السريع يقفز", "🦊🐶 fox"]


def test_perplexity_equals_the_plain_model(spark, monkeypatch):
    # small chunks, so that n-grams are asked for by several of them
    monkeypatch.setattr(kneser_ney, "CHUNK_BYTES", 200)
    monkeypatch.setattr(kneser_ney, "PACK_BYTES", 100)
    trusted = [brute.prose(k, 12) for k in range(8)] + OTHER_SCRIPTS + [None, ""]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3))
    p = _plain_model([_halved(t) for t in trusted])
    texts = [brute.prose(3, 12), "W7 !! $$$", "never seen é", "x", "лиса и собака", "狐狸跳", "\n\n", None, "", *OTHER_SCRIPTS]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(2)
    got = kneser_ney.scored(rows, model).collect()
    assert sorted(r["k"] for r in got) == list(range(len(texts)))
    for r in got:
        assert r["text"] == texts[r["k"]]
        if not texts[r["k"]]:
            assert r["bits"] is None and r["n_symbols"] == 0
            continue
        want = _plain_bits(p, _halved(texts[r["k"]]))
        assert r["n_symbols"] == len(want) and r["bits"] == pytest.approx(sum(want) / len(want), abs=1e-4)


def test_probabilities_of_each_context_sum_to_one(spark):
    trusted = [brute.prose(k, 30) for k in range(5)] + OTHER_SCRIPTS
    p, signs = _plain_model([_halved(t) for t in trusted]), sorted(set("".join(trusted)))
    signs = [c for c in signs if c < "\U00010000"]
    halves = sorted(set(_halved("".join(trusted))) - set(signs))
    # the last one stands for all characters that were never seen
    contexts = [trusted[0][:3], "\n\n\n", "狐狸跳", "zzz"]
    for context in contexts:
        assert sum(p(context + c) for c in [*signs, *halves, "\0"]) == pytest.approx(1)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    rows = spark.createDataFrame([(k, c + x) for k, c in enumerate(contexts) for x in [*signs, "\0"]] + [(k + 10, c) for k, c in enumerate(contexts)], "k int, text string")
    bits = {(r["k"], r["text"]): r["bits"] * r["n_symbols"] for r in kneser_ney.scored(rows, model).collect()}
    for k, c in enumerate(contexts):
        rest = sum(p(c + x) for x in halves)
        assert sum(2 ** (bits[k + 10, c] - bits[k, c + x]) for x in [*signs, "\0"]) + rest == pytest.approx(1, abs=1e-3)


def test_scripts_are_told_apart(spark):
    """Text in a script that the trusted text has is likelier than shuffled characters of the same script."""
    trusted = OTHER_SCRIPTS * 3 + [brute.prose(1, 30)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    pairs = [(k, half, t if half == 0 else t[::-1]) for k, t in enumerate(OTHER_SCRIPTS[:4]) for half in (0, 1)]
    bits = {(r["k"], r["half"]): r["bits"] for r in kneser_ney.scored(spark.createDataFrame(pairs, "k int, half int, text string"), model).collect()}
    assert all(bits[k, 0] + 1 < bits[k, 1] for k in range(4))


def test_texts_are_written_once_and_never_shuffled(spark, monkeypatch):
    """Of the texts only packs are written, and scoring shuffles the answers alone, also with several chunks to a bucket."""
    monkeypatch.setattr(kneser_ney, "CHUNK_BYTES", 200)
    monkeypatch.setattr(kneser_ney, "PACK_BYTES", 100)
    written = []
    write = kneser_ney.materialise
    monkeypatch.setattr(kneser_ney, "materialise", lambda df, *name: written.extend(df.columns) or write(df, *name))
    docs = spark.createDataFrame([(i % 90, brute.prose(i, 20), "en") for i in range(120)], "doc_id int, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id int, quality int")
    got = kneser_ney.judge_perplexity(docs, labels)
    assert "text" not in written and "rows" not in written
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("packs")]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_scoring_leaves_no_memory_with_idle_workers(spark):
    """Each chunk's arrays go back to the system once it is scored."""
    import numpy as np
    import pyarrow as pa

    from flowlens.llm.batches import tidied_groups

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(left, right):
        held = [np.ones(6_000) for _ in range(4_000)]
        kept.append(held[-1])  # the top of the heap stays in use, so it doesn't shrink by itself
        return pa.table({"n": [len(held)]})

    kept = []
    before = resident()
    assert tidied_groups(work)(None, None).column("n").to_pylist() == [4_000]
    assert resident() - before < 60 << 20


def test_texts_are_scored_by_joins(spark):
    model = kneser_ney.train(spark.createDataFrame([(brute.prose(1, 30),)], "text string"))
    plan = kneser_ney.scored(spark.createDataFrame([(1, "w1 w2")], "k int, text string"), model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "ResolvedHint" not in plan and "broadcast" not in plan.lower()


def test_quality_classifier_tells_junk_from_trusted(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op6_quality_classifier"](spark, sf_dir).join(labels, "doc_id")
    share = {r["quality"]: r["s"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.98 and share[0] < 0.3


def test_quality_classifier_on_awkward_rows(spark, corpus, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (7, 1), (None, 1)], "doc_id bigint, quality int")
    got = kneser_ney.judge_perplexity(corpus, labels)
    rows = got.collect()
    assert len(rows) == corpus.count()
    assert not any(r["kept"] for r in rows if not r["text"]) and all(r["perplexity"] is None for r in rows if not r["text"])
    assert kneser_ney.judge_perplexity(empty, labels).count() == 0
    untrained = kneser_ney.judge_perplexity(corpus, labels.limit(0)).collect()
    assert all(r["kept"] == bool(r["text"]) for r in untrained)


# votes


def _measures(text):
    w = brute.words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("source", ["awkward", "given"])
def test_measures_equal_plain_counts(spark, sf_dir, corpus, source):
    docs = corpus if source == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL").collect()}
    got = quality_votes.judge_quality(docs)
    assert got.count() == docs.count()
    for r in got.where("doc_id IS NOT NULL").collect():
        want = _measures(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_votes_find_a_rule_that_says_nothing(spark):
    rows = [(1, 1, (-1) ** k) for k in range(80)] + [(-1, -1, (-1) ** k) for k in range(20)]
    share, rates = quality_votes.fit_votes(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"])
    assert 0.75 < share < 0.88
    lift = {r: x["bad"][0] / x["good"][0] for r, x in rates.items()}
    assert lift["a"] > 10 and lift["b"] > 10 and lift["c"] < 2


def test_votes_keep_clean_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = QUERIES["op8_quality_rules"](spark, sf_dir).join(labels, "doc_id").where("NOT base_failed")
    assert got.where("quality = 1 AND NOT kept").count() == 0
    assert got.where("quality = 0 AND NOT kept").count() > 0


def test_votes_reject_labelled_junk_and_keep_clean_documents(spark, sf_dir):
    large = sf_dir.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    got = QUERIES["op8_quality_rules"](spark, large).join(labels, "doc_id").where("NOT base_failed")
    kept = {r["quality"]: (r["kept"], r["n"]) for r in got.groupBy("quality").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    print("kept of labelled texts that pass the base rule", kept)
    assert kept[0][0] <= 0.05 * kept[0][1] and kept[1][0] >= 0.999 * kept[1][1]


def test_rates_of_votes_follow_the_data_at_every_size(spark):
    for times in (20, 2000):
        rows = spark.range(times).selectExpr("explode(array(" + "1, " * 18 + "-1, -1)) AS a").selectExpr("a", "1 AS b", "a AS c")
        _, rates = quality_votes.fit_votes(rows, ["a", "b", "c"])
        assert rates["a"]["bad"][0] > 0.6 and rates["b"]["bad"][2] > 0.7


# secrets


def test_secrets_are_found_and_numbers_are_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = secrets.scan_secrets(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = rows.collect()
    for r in found:
        assert text[r["doc_id"]][r["start"] : r["start"] + len(r["value"])] == r["value"]
    import re

    want = {(d, m.group(1)) for d, t in text.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert {(r["doc_id"], r["value"]) for r in found if r["kept"]} == want
    everything = {(d, m.start(), m.group(0)) for d, t in text.items() for m in re.finditer(r"[0-9A-Za-z+/=_-]{9,}", t) if re.search(r"\d", m.group(0))}
    assert {(r["doc_id"], r["start"], r["value"]) for r in found} == everything


def test_secrets_in_awkward_rows(spark, corpus, empty):
    assert secrets.scan_secrets(empty).count() == 0
    rows = spark.createDataFrame([(1, 'key = "abcd1234efgh5678ijkl"'), (2, None), (3, ""), (None, "card 4444333322221111")], "doc_id bigint, text string")
    got = {r["value"]: r for r in secrets.scan_secrets(brute.clash(rows)).collect()}
    assert set(got) == {"abcd1234efgh5678ijkl", "4444333322221111"}
    assert got["abcd1234efgh5678ijkl"]["start"] == 7


def test_secrets_of_other_forms_are_found(spark):
    import random

    r = random.Random(3)
    word = lambda n, signs="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(signs) for _ in range(n))
    token = ".".join(["eyJ" + word(17), "eyJ" + word(30), word(43)])
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    wanted = {
        "API_KEY=abc1def2ghi3jkl4": "abc1def2ghi3jkl4",
        f"aws_secret_access_key = {aws}": aws,
        "token:abc123def456ghi789": "abc123def456ghi789",
        f"Authorization Bearer {token} sent": token,
        "postgres://admin:s3cr3tPass9@db.example.com/x": "s3cr3tPass9",
        "password: correcthorse": "correcthorse",
        "pwd = p@ss!w$rd~x": "p@ss!w$rd~x",
        "passwd=hunterab": "hunterab",
    }
    rows = [(k, f"some words here {line} and more") for k, line in enumerate(wanted)]
    rows += [(100 + k, f'token = "{word(40, "0123456789abcdef")}" in a text') for k in range(60)]
    rows += [(200 + k, f"card {word(16, '0123456789')} paid") for k in range(60)]
    rows += [(300 + k, f"see src/lib{k}/part{k}/name{k}.py there") for k in range(60)]
    rows += [(400 + k, f"at https://example.com/page/item{k:05d}/view and on") for k in range(60)]
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = {(x["doc_id"], x["value"]) for x in found if x["kept"]}
    assert {(k, v) for k, v in enumerate(wanted.values())} <= kept
    assert not {d for d, _ in kept if d >= 200}


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(VOCABULARY)


def _all_segmentations(v, unit):
    if not unit:
        return [(0.0, ())]
    out = []
    for end, piece, score in v.arcs(unit, 0):
        own = (piece,) if piece >= 0 else tuple(v.spelt(unit[0])[0])
        out += [(score + s, own + ids) for s, ids in _all_segmentations(v, unit[end:])]
    return out


@pytest.mark.parametrize("unit", ["▁hello", "▁thes", "▁▁a", "▁", "▁日本é", "\n", "▁x\u2003y", "aaaaaa"])
def test_n_best_units_equal_all_segmentations(vocabulary, unit):
    want = sorted((s for s, _ in _all_segmentations(vocabulary, unit)), reverse=True)[:6]
    got = pieces.n_best(vocabulary, unit, 6)
    assert [s for s, _ in got] == pytest.approx(want)
    assert len({tuple(ids) for _, ids in got}) == len(got)
    for k in (1, 8):
        score, gap, ids = pieces.best_of_units(vocabulary, [unit] * k)
        assert score[0] == pytest.approx(want[0])
        assert gap[0] == pytest.approx(want[0] - want[1]) if len(want) > 1 else np.isinf(gap[0])
        assert (pytest.approx(want[0]), tuple(ids[0])) in [(s, i) for s, i in _all_segmentations(vocabulary, unit)]


def test_n_best_of_a_text_equal_all_segmentations(spark, vocabulary):
    text = "he at ▁to\nin"
    lattices = []
    for u in pieces.units_of(text):
        lattices.append([(vocabulary.spelt("▁")[1], ())] if u is None else _all_segmentations(vocabulary, u))
    sums = [0.0]
    for options in lattices:
        sums = [a + s for a in sums for s, _ in options]
    want = sorted(sums, reverse=True)[:5]
    got = pieces.encode_texts(spark.createDataFrame([(text,)], "text string"), vocabulary, n=5).first()
    assert got["scores"] == pytest.approx(want) and got["score"] == pytest.approx(want[0])


def test_pieces_give_the_text_back(spark, corpus, vocabulary, sf_dir):
    for docs in (corpus, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        coded = pieces.decode_pieces(pieces.encode_texts(docs, vocabulary, n=2), vocabulary)
        assert coded.count() == docs.count()
        assert coded.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
        assert coded.where("text = '' AND size(pieces) > 0").count() == 0
        assert coded.where("text IS NULL AND pieces IS NOT NULL").count() == 0


@pytest.mark.parametrize("letters", ["x", "abcdefghijklmnopqrstuvwxyz"])
def test_a_word_of_a_million_letters(vocabulary, letters):
    r = random.Random(6)
    word = "".join(r.choice(letters) for _ in range(1_000_000))
    total, ids, scores = next(pieces.Encoder(vocabulary).encode([word], 3))
    assert pieces._text(pieces._raw(vocabulary), ids) == word
    found = [s for s, _ in scores]
    assert len(found) == 3 and found[0] == total and found == sorted(found, reverse=True)


def test_the_cache_of_units_holds_few_characters(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for k in range(6):
        list(encoder.encode([f"{k}" * pieces.CACHE_CHARS], 2))
        assert encoder.chars <= pieces.CACHE_CHARS + 1


# empty tables


def test_empty_tables_give_empty_results(empty, vocabulary):
    assert jaccard.similar_documents(empty).count() == 0
    assert jaccard.one_of_each(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert quality_votes.judge_quality(empty).count() == 0
    assert pieces.encode_texts(empty, vocabulary).count() == 0
