"""The whole way from a raw flow table to a quality report, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.labels import fit_codes, merge_web_attacks, normalise_dash
from flowlens.operators.cleaning import clean_flows
from flowlens.operators.evaluation import report
from flowlens.operators.sampling import stratified_split
from flowlens.plans.forests import ForestSize, fit_code_classifier
from flowlens.runtime import materialise


def detect_attacks(
    raw: DataFrame, key: str, features: list[str], label: str = "label", size: ForestSize = ForestSize(), seed: int = 0
) -> DataFrame:
    """Clean, merge labels, split by class, grow a forest, score the held-out rows, report per class."""
    clean = clean_flows(raw, features, label).withColumn(label, merge_web_attacks(normalise_dash(F.col(label))))
    clean = materialise(clean.select(key, *features, label), "clean")
    parts = stratified_split(clean, key, {"train": 0.8, "test": 0.2}, seed, label)
    codes = fit_codes(clean, label, "code")
    coded = codes.transform(parts)
    model = fit_code_classifier(coded.where("split = 'train'"), features, "code", size)
    scored = model.transform(coded.where("split = 'test'"))
    names = F.array(*[F.lit(n) for n in codes.labels])
    named = scored.withColumn("prediction", F.element_at(names, F.col("prediction").cast("int") + 1))
    return report(named, label, "prediction")
