"""Quality of a text by weak supervision: rules vote or abstain, their accuracies are estimated without labels.

Words are maximal runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
Every rule looks at one measure of the whole text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns estimates, for each rule, how often it votes good
on good and on bad texts; a text's posterior probability of being good follows from its votes, and replaces
a list of rules that all have to pass.

A text fails the base rule if it has fewer than ``MIN_WORDS`` words, or more than half of its words lie in
3-word windows that the text has twice or more. Such a text is not kept, whatever the votes. The rates are
those of the texts that pass, which alone the votes decide: otherwise the many symptoms of repeating texts
fill the bad class, and a text with one symptom counts as good.

Null, empty and blank texts have no words, so all measures are 0 and they fail. A pattern table has at
most 3 ** rules rows; only its sums reach the driver. Ids may be null or repeat; other columns are never read.
DataFrame functions only: 3-word windows are hashed and sorted inside the row, so a row of n words takes
n log n steps. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column as named
from flowlens.runtime import materialise

MIN_WORDS = 50
ROUNDS = 1000
#: The rounds end when the share of good texts moves less than this.
STILL = 1e-9
KEEP = 0.5
#: Priors: share of good texts; rates of votes -1, 0 and 1 on good and on bad texts; their weight in
#: texts for each class, which does not grow with the table.
GOOD_SHARE = 0.85
GOOD_VOTES = (0.01, 0.09, 0.9)
BAD_VOTES = (0.25, 0.1, 0.65)
PRIOR = 20.0
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
_MARKS = ".!?:;,"


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts of every row."""
    text = F.coalesce(named(text_col), F.lit(""))
    base = docs.select(
        named(id_col).alias("id"),
        text.alias("text"),
        F.filter(F.split(text, _SPACE, -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("windows", windows)
    base = base.withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))

    # one pass over the text takes out the signs and capitals, which are then told apart
    base = base.withColumn("signs", F.regexp_replace("text", rf"[^{_SYMBOLS}{_MARKS}\p{{Lu}}]+", ""))
    base = base.withColumn("marks", F.regexp_replace("signs", r"\p{Lu}+", ""))
    return base.select(
        "id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.translate("marks", _MARKS, "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered(F.col("windows"))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.length("signs") - F.length("marks")).cast("bigint").alias("n_upper"),
        F.length(F.translate("marks", _SYMBOLS, "")).cast("bigint").alias("n_marks"),
    )


def _covered(windows: Column) -> Column:
    """Places of words in windows that occur twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the sorted array is bound once, as the only element of an array, so that it is not computed for each use
    places = F.flatten(
        F.transform(
            F.array(ordered),
            lambda s: F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))),
                lambda x: x["i"],
            ),
        )
    )
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def votes() -> dict[str, Column]:
    """Votes of the rules on a row of ``measures``: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def rule(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    mean = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeats = F.col("n_repeat_words") / words
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    marks = F.col("n_marks") / words
    return {
        "length": rule(words, (words >= 100) & (words <= 100_000), words < 30),
        "word_length": rule(mean, (mean >= 3.5) & (mean <= 7), (mean < 2.5) | (mean > 7.5)),
        "symbols": rule(symbols, symbols <= 0.02, symbols > 0.1),
        "lines": rule(lines, lines <= 0.1, lines > 0.4),
        "repeats": rule(repeats, repeats <= 0.1, repeats > 0.3),
        "capitals": rule(upper, upper <= 0.1, upper > 0.3),
        "marks": rule(marks, (marks >= 0.02) & (marks <= 0.5), marks > 0.9),
    }


def fit_votes(voted: DataFrame, rules: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, dict[str, list[float]]]]:
    """(share of good texts, for each rule and class the rates of votes -1, 0 and 1) by expectation-maximisation.

    The pattern table has at most 3 ** rules rows, whatever the number of texts; the rounds run over it. They start
    from the prior rates, which tell the two classes apart: a good text seldom gets a bad vote, a bad one often gets
    some good ones. As PRIOR texts of each class the priors also keep rates off 0; on small tables they still weigh.
    """
    patterns = [(tuple(r[k] for k in rules), r["n"]) for r in voted.groupBy(*rules).agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in patterns)
    weight = PRIOR
    share, rates = GOOD_SHARE, {r: {"good": list(GOOD_VOTES), "bad": list(BAD_VOTES)} for r in rules}
    for _ in range(rounds):
        good = 0.0
        sums = {r: {"good": [weight * p for p in GOOD_VOTES], "bad": [weight * p for p in BAD_VOTES]} for r in rules}
        for votes_of, n in patterns:
            odds = math.log(share / (1 - share))
            odds += sum(math.log(rates[r]["good"][v + 1] / rates[r]["bad"][v + 1]) for r, v in zip(rules, votes_of))
            q = 1 / (1 + math.exp(-max(min(odds, 500), -500)))
            good += n * q
            for r, v in zip(rules, votes_of):
                sums[r]["good"][v + 1] += n * q
                sums[r]["bad"][v + 1] += n * (1 - q)
        last, share = share, (good + GOOD_SHARE * weight) / (total + weight)
        rates = {r: {c: [x / sum(row) for x in row] for c, row in sums[r].items()} for r in rules}
        if abs(share - last) < STILL:
            break
    return share, rates


def _posterior(share: float, rates: dict) -> Column:
    """Probability that a text with the votes of its row is good."""
    odds = F.lit(math.log(share) - math.log(1 - share))
    for r, x in rates.items():
        step = [math.log(g) - math.log(b) for g, b in zip(x["good"], x["bad"])]
        odds = odds + F.element_at(F.array(*[F.lit(s) for s in step]), F.col(r) + 2)
    return 1 / (1 + F.exp(-odds))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """Measures, base_failed, posterior and kept of every row."""
    measured = materialise(measures(docs, id_col, text_col), "measures")
    rules = votes()
    voted = measured.select("*", *[v.alias(f"vote_{k}") for k, v in rules.items()])
    names = [f"vote_{k}" for k in rules]
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    share, rates = fit_votes(voted.where(~failed).select(*names), names)
    judged = voted.withColumn("base_failed", failed).withColumn("posterior", _posterior(share, rates))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep)).withColumnRenamed("id", id_col)
