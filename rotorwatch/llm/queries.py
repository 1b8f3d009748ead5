"""Registered queries of this package: ``QUERIES`` and, where SQL can express them, ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorwatch.llm import (
    exact_dedup, jaccard, maxent_lm, mixing, packing, quality_qda, quality_rules, secrets, source_audit,
    substring_dedup, suffix_dedup, toxicity, whitening,
)
from rotorwatch.llm.rows import remainder

#: Target weights of the mix: of the sources named, of each other one, and how many of those are told apart.
WEIGHTS = {"src0": 12}
REST_WEIGHT = 4
OTHERS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every_row(documents: DataFrame) -> DataFrame:
    """Each row as often as the very document occurs in the input."""
    return documents.withColumn("_ll_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))


def op1_best_fit_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_pfair_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, REST_WEIGHT, others=OTHERS)
    return mixed.select("doc_id", "source", "block", "slot", "release", "deadline", "position")


def op4_line_first_rules(spark, sf_dir):
    judged = quality_rules.clean(table(spark, sf_dir, "documents"))
    return judged.drop("cleaned")


def toxicity_model(spark, docs, sf_dir):
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "log_ratio")


def op6_ngram_jaccard(spark, sf_dir):
    near = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return every_row(near).select("doc_id", "class_id", "n_links")


def op7_exact_dedup(spark, sf_dir):
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return every_row(groups).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_substring_dedup(spark, sf_dir):
    clean = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, counts, ranks = maxent_lm.fit(docs, remainder(7) != 2)
    scored = maxent_lm.score(ranks, model, counts)
    return scored.withColumn("held_out", remainder(7) == 2)


def op10_quality_qda(spark, sf_dir):
    from rotorwatch.session import materialize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality_qda.features(docs), "statistics")
    model = quality_qda.fit(stats, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = quality_qda.score(stats, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op11_suffix_dedup(spark, sf_dir):
    clean = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark, sf_dir):
    parts = whitening.whitened_components(table(spark, sf_dir, "embeddings"))
    return parts.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_source_audit(spark, sf_dir):
    return source_audit.audit(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_secret_scan, op3_pfair_mix, op4_line_first_rules, op5_toxicity, op6_ngram_jaccard,
    op7_exact_dedup, op8_substring_dedup, op9_lm_scoring, op10_quality_qda,
    op11_suffix_dedup, op12_whitening, op13_source_audit, pipeline,
)}

SQL = {
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_source_audit": r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS text FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT k) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  CAST(1 + 1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT // (g.total + 5 * g.v)::HUGEINT AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + 1000000000 * (sum(n) + 5)::HUGEINT //
  (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS BIGINT) AS q
  FROM counts GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50""",
}
