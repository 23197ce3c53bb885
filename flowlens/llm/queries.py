"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.llm import (
    fill_middle,
    jaccard,
    kneser_ney,
    language,
    line_dedup,
    mixing,
    near_vectors,
    pieces,
    quality_votes,
    secrets,
    url_rules,
    vector_codes,
    warc,
)
from flowlens.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_URL_SQL = """
WITH u AS (
  SELECT page_id, url, position('://' IN url) AS p FROM pages
), h AS (
  SELECT page_id,
         CASE WHEN coalesce(p, 0) = 0 THEN '' ELSE translate(regexp_extract(substr(url, p + 3), '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN coalesce(p, 0) = 0 THEN '' ELSE
              regexp_extract(substr(url, p + 3 + length(regexp_extract(substr(url, p + 3), '^[^/?#]*'))), '^[^?#]*') END AS path
  FROM u
), r(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), numbered AS (
  SELECT row_number() OVER () AS n, * FROM h
), fits AS (
  SELECT n, r.rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC, r.rule) AS k
  FROM numbered JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (n)
"""


@query("op1_url_filters", _URL_SQL)
def op1_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """Per document: pieces, the scores of the three best segmentations, and whether decoding gives the text back."""
    vocabulary = pieces.load_vocabulary(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_texts(docs, vocabulary, n=3, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("pieces").cast("bigint").alias("n_pieces"),
        "score",
        F.get("scores", F.lit(1)).alias("second_score"),
        F.get("scores", F.lit(2)).alias("third_score"),
        F.md5(F.array_join("pieces", " ").cast("binary")).alias("pieces_md5"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    langs, matrix = language.train_languages(docs.where(~held))
    # the fold depends on the id alone, so it is told from the id that comes back
    return language.detect_language(docs, langs, matrix).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op5_mixing_sources")
def op5_mixing_sources(spark, sf_dir):
    """Per document what the mix takes of it, and the shard of each copy that the splitting tree deals out."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = kneser_ney.judge_perplexity(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_symbols", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")


@query("op7_secret_scans")
def op7_secret_scans(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    judged = quality_votes.judge_quality(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, F.round("posterior", 6).alias("posterior"))


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    """Per document: lines, the numbers of the deleted ones, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    left = line_dedup.drop_repeated_lines(docs.withColumn("n_lines", F.coalesce(breaks + 1, F.lit(0)).cast("bigint")))
    return left.select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("bigint").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
        F.length("text").cast("bigint").alias("n_chars_left"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def _codes_sql() -> str:
    """Codebooks and codes by comparing every part with every entry."""
    dimensions = "SELECT unnest(range(64)) AS d"
    assigned = """a{0} AS (
  SELECT vec_id, part, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS gap
    FROM x JOIN b{0} b ON x.part = b.part AND x.place = b.place GROUP BY ALL) GROUP BY ALL)"""
    moved = """m{0} AS (
  SELECT x.part, a.entry, x.place, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{0} a USING (vec_id, part) GROUP BY ALL
), b{1} AS (
  SELECT part, entry, place, CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
  FROM b{0} b LEFT JOIN m{0} m USING (part, entry, place))"""
    return f"""
WITH kept AS (
  SELECT vec_id, embedding, label FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS (
  SELECT vec_id, d // 4 AS part, d % 4 AS place, CAST(floor(256 * CAST(embedding[d + 1] AS DOUBLE)) AS BIGINT) AS v FROM kept, ({dimensions})
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), b0 AS (
  SELECT part, entry, place, v FROM x JOIN firsts USING (vec_id)
), {assigned.format(0)}, {moved.format(0, 1)}, {assigned.format(1)}, {moved.format(1, 2)}, {assigned.format(2)}, codes AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark, sf_dir):
    return vector_codes.compressed_vectors(table(spark, sf_dir, "embeddings"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)

_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p
), f AS (
  SELECT *, first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS least,
         row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS k
  FROM h
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to
FROM f
"""


@query("op12_warc", _WARC_SQL)
def op12_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


_FILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), u AS (
  SELECT *, string_split(text, chr(10)) AS lines,
         length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS n,
         CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), e AS (
  SELECT *, CASE WHEN a = 0 THEN 0 WHEN a = n THEN length(text) ELSE length(array_to_string(lines[1:a], chr(10))) + 1 END AS p,
         CASE WHEN b = 0 THEN 0 WHEN b = n THEN length(text) ELSE length(array_to_string(lines[1:b], chr(10))) + 1 END AS q
  FROM c
), s AS (
  SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


@query("op13_fill_in_middle", _FILL_SQL)
def op13_fill_in_middle(spark, sf_dir):
    """Per document the cut, the hash of the output, and of the text that the output gives back."""
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
