"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is, from each place on, the first that fits of: a value of at least 8 signs without blanks, quotes,
brackets, commas and semicolons that is assigned (``=``, ``:``, ``=>``) to a name that ends with one of ``NEIGHBOURS`` or has
such a word before ``_`` or ``-``; the password of ``scheme://user:password@``; a JSON web token; a maximal run of at least
``MIN_LENGTH`` letters, digits and ``+/=_-`` that has a digit and is not such a name with its value. The forest sees its length, changes between character classes, shares of digits, capitals and hexadecimal
digits, distinct characters, how much of its letters a dictionary of frequent letter pairs covers, whether it
lies in a path or address, quotes and assignment signs around it, whether it has one of the first three
forms, and which of ``NEIGHBOURS`` stand before it. It is trained from labelled findings and gives each candidate the probability of being a secret.

``labelled_findings`` labels by format what a format decides: a value of 16 or more signs that is assigned to a
credential name and quoted or mixed of digits and others is a secret, and so are web tokens and passwords in
addresses. Runs of digits only, what follows ``scheme://``, the user of a mail address, three or more short segments of
one case and names with a file ending are not. A slash, dot or colon alone decides nothing. Everything else
stays unlabelled and is decided by the forest. At most ``MAX_LABELLED`` labelled findings of each class
(smallest hashes of text and context) are used to fit; candidates are searched and judged in all texts.

Null and empty texts have no candidates. Ids may be null or repeat. If there are no labelled findings of
both classes nothing can be learned: every candidate is kept with probability 1. Other columns are not read.
DataFrame functions and the library's forest only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column as named
from flowlens.runtime import materialise

MIN_LENGTH = 9
MAX_LABELLED = 20_000
TREES, DEPTH = 40, 8
CONTEXT = 40
#: Frequent letter pairs that make up the dictionary.
PAIRS = 300
# fixed values: words that go before credentials
NEIGHBOURS = ["token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "bearer", "credential"]
_SET = "[0-9A-Za-z+/=_-]"
_VALUE = "[^\\s\"'`<>,;(){}\\[\\]]"
_NAME = rf"(?i:{'|'.join(NEIGHBOURS)})(?:[_-][0-9A-Za-z_-]{{0,16}})?"
_SIGN = "[=:]>?[ \\t]{0,3}[\"'`]?"
#: What stands before a value that is assigned to a credential name, and before a password in an address.
_CLAIM = rf"{_NAME}[\"'`]?[ \t]{{0,3}}{_SIGN}"
_LOGIN = r"://[^\s/:@]{1,64}:"
_JWT = "eyJ[0-9A-Za-z_-]{6,}[.][0-9A-Za-z_-]{6,}(?:[.][0-9A-Za-z_-]+)?"
# short tests of what stands before come first, as most places fail them
_ASSIGNED = rf"(?<=[=:> \t\"'`])(?<={_SIGN})(?<={_CLAIM}){_VALUE}{{8,}}(?<![.])"
_PASSWORD = rf"(?<=:)(?<={_LOGIN})[^\s/@]{{6,}}(?=@)"
_RUN = rf"(?<!{_SET})(?={_SET}*[0-9])(?![0-9A-Za-z_-]{{0,40}}{_NAME}={_VALUE}{{8}}){_SET}{{{MIN_LENGTH},}}"
PATTERN = rf"{_ASSIGNED}|{_PASSWORD}|(?<!{_SET}){_JWT}|{_RUN}"
# fixed values: endings of file names
_ENDING = r"^[.](?:py|js|ts|java|c|h|cpp|go|rs|sh|html?|css|png|jpe?g|gif|svg|json|xml|ya?ml|txt|csv|md|pdf|log|zip|gz|tar|exe|dll|so)\b"
FORMS = ["claimed", "login", "web_token"]
FEATURES = ["length", "changes", "digits", "capitals", "hex", "distinct", "covered", "path", "address", "quoted", "assigned", *FORMS, *[f"near_{w}" for w in NEIGHBOURS]]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, value, before, after) of every candidate; ``start`` is its offset in code points."""
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).where(F.col("text").rlike("[0-9=:]"))
    rows = rows.select("id", F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("values"), F.split("text", PATTERN, -1).alias("gaps"))
    rows = rows.where(F.size("values") > 0)
    ends = F.aggregate(
        F.zip_with("gaps", "values", lambda g, v: F.struct(F.length(g).alias("g"), F.coalesce(F.length(v), F.lit(0)).alias("v"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["v"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    rows = rows.withColumn("starts", ends).select("id", "gaps", "starts", F.posexplode("values").alias("k", "value"))
    return rows.select(
        "id",
        F.get("starts", F.col("k")).alias("start"),
        "value",
        F.right(F.get("gaps", F.col("k")), F.lit(CONTEXT)).alias("before"),
        F.left(F.get("gaps", F.col("k") + 1), F.lit(CONTEXT)).alias("after"),
    )


def dictionary(found: DataFrame) -> list[str]:
    """The most frequent pairs of neighbouring letters in the prose around all candidates: at most PAIRS strings."""
    prose = found.select(F.lower(F.regexp_replace(F.concat_ws(" ", "before", "after"), r"[^A-Za-z]+", " ")).alias("t"))
    even = F.regexp_extract_all("t", F.lit("[a-z][a-z]"), 0)
    odd = F.regexp_extract_all(F.regexp_replace("t", r"(^| )[a-z]", " "), F.lit("[a-z][a-z]"), 0)
    pairs = prose.select(F.explode(F.concat(even, odd)).alias("pair")).groupBy("pair").count()
    top = pairs.orderBy(F.desc("count"), "pair").limit(PAIRS).collect()
    return sorted(r["pair"] for r in top)


def described(found: DataFrame, pairs: list[str]) -> DataFrame:
    """Adds the features."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    size = F.length(v)

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / size

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    letters = F.lower(F.regexp_replace(v, "[^A-Za-z]", ""))
    known = F.array(*[F.lit(p) for p in pairs]) if pairs else F.array().cast("array<string>")
    places = F.when(F.length(letters) >= 2, F.sequence(F.lit(1), F.length(letters) - 1)).otherwise(F.array().cast("array<int>"))
    covered = F.size(F.filter(places, lambda i: F.array_contains(known, F.substring(letters, i, F.lit(2)))))
    near = F.lower(before)
    return found.select(
        "*",
        size.cast("double").alias("length"),
        (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / size).alias("changes"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        share("[0-9a-fA-F]").alias("hex"),
        (F.size(F.array_distinct(F.split(v, ""))) / size).alias("distinct"),
        (covered / F.greatest(F.size(places), F.lit(1))).alias("covered"),
        (v.contains("/") | before.rlike(r"[/\\]$") | after.rlike(r"^[/\\]")).cast("double").alias("path"),
        (before.rlike(r"[.@:]$") | after.rlike(r"^[.@:][0-9A-Za-z]")).cast("double").alias("address"),
        (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double").alias("quoted"),
        before.rlike(r"[=:]\s*[\"'`]?$").cast("double").alias("assigned"),
        before.rlike(rf"{_CLAIM}$").cast("double").alias("claimed"),
        (before.rlike(rf"{_LOGIN}$") & after.startswith("@")).cast("double").alias("login"),
        v.rlike(rf"^{_JWT}$").cast("double").alias("web_token"),
        *[near.contains(w).cast("double").alias(f"near_{w}") for w in NEIGHBOURS],
    )


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings whose format decides: label 1.0 secret, 0.0 not."""
    named_value = F.greatest(*[F.col(f"near_{w}") for w in NEIGHBOURS]) > 0
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    quoted = (F.col("quoted") > 0) & (F.col("assigned") > 0) & named_value & (F.col("length") >= 16)
    mixed = (F.col("claimed") > 0) & (F.col("length") >= 16) & (F.col("digits") > 0) & (F.col("digits") < 1)
    secret = quoted | mixed | (F.col("login") > 0) | (F.col("web_token") > 0)
    address = before.rlike(r"[A-Za-z]{2,}://\S*$") | (after.rlike("^@[0-9A-Za-z-]+[.][A-Za-z]") & ~before.endswith(":"))
    segments = F.concat(F.regexp_extract(before, r"[0-9A-Za-z_./-]*$", 0), value)
    path = segments.rlike("^/?(?:(?:[a-z0-9_.-]{1,12}/){2,}[a-z0-9_.-]{0,20}|(?:[A-Z0-9_.-]{1,12}/){2,}[A-Z0-9_.-]{0,20})$") | after.rlike(_ENDING)
    harmless = (F.col("claimed") == 0) & ((F.col("digits") == 1) | address | path)
    label = F.when(secret, F.lit(1.0)).when(harmless, F.lit(0.0))
    return found.withColumn("label", label).where("label IS NOT NULL")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """(id, start, value, probability, kept) of every candidate of every text.

    ``labelled``: findings with value, before, after and label (1.0 or 0.0); by default those that
    ``labelled_findings`` gives for these texts.
    """
    found = materialise(candidates(docs, id_col, text_col), "candidates")
    pairs = dictionary(found)
    rows = described(found, pairs)
    known = labelled_findings(rows) if labelled is None else described(labelled, pairs)
    known = materialise(known.select(*FEATURES, "label", F.xxhash64("value", "before", "after").alias("draw")), "labelled")
    sample = None
    for label in (0.0, 1.0):
        part = known.where(F.col("label") == label).orderBy("draw", *FEATURES).limit(MAX_LABELLED)
        sample = part if sample is None else sample.union(part)
    sample = materialise(sample, "training")
    if sample.select("label").distinct().count() < 2:
        judged = rows.withColumn("probability", F.lit(1.0))
    else:
        to_vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label")
        # one partition, so that the draws of the forest do not depend on how the bounded sample is spread
        model = forest.fit(to_vector.transform(sample.coalesce(1)))
        scored = model.transform(to_vector.transform(rows))
        judged = scored.withColumn("probability", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return judged.select(F.col("id").alias(id_col), "start", "value", "probability", (F.col("probability") >= keep).alias("kept"))
