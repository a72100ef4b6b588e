"""Registered queries of this folder, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm import (
    divergence, fill_middle, htmltext, langid, licenses, mixing, packing, pii, quality, secrets, simhash, token_files, topk,
)
from stagewise.llm.common import ready

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SURROGATE_KEY = "surrogates-1"  # a parameter: who holds it can recompute replacements, so real data wants a secret one
QUERY_EVERY = 50
SCALE = 256


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.replaced(docs, SURROGATE_KEY, counts={"entities": "n_entities"})


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(_table(spark, folder, "documents"), TOKENIZER)


def op4_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_tag_path_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(_table(spark, folder, "pages"))


def op6_fair_queue_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ffd_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), TOKENIZER)


def op8_histogram_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantized(_table(spark, folder, "embeddings"), "vec_id", "embedding", SCALE)
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


def op9_divergence_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(licenses.document_files(_table(spark, folder, "documents")))


def op11_wavelet_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_middle.fill_in_middle(_table(spark, folder, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"),
    )


def op12_automaton_secrets(spark: SparkSession, folder: str) -> DataFrame:
    kinds = [r.kind for r in secrets.BASE]
    spans = F.col("spans")
    return secrets.scan(_table(spark, folder, "documents")).select(
        "doc_id", *[F.size(secrets.of_kinds(spans, k)).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.listed(secrets.of_kinds(spans, *kinds)), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"),
    )


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_surrogates, op2_language_id, op3_token_files, op4_simhash_golay, op5_tag_path_text, op6_fair_queue_mix, op7_ffd_packing, op8_histogram_topk,
        op9_divergence_quality, op10_license_scan, op11_wavelet_fill_middle, op12_automaton_secrets, op13_source_divergence,
    )
}

ORACLES = {
    "op6_fair_queue_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', 'mix-1', coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS ticket
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS bound FROM sources),
levels AS (
  SELECT *, bound / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(bound) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(level, struct_pack(r := ratio, p := place)) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, place,
    CASE WHEN (SELECT sum(source_size) FROM levels) = 0 THEN 0.0 WHEN ratio < (SELECT level FROM found) THEN CAST(bound AS DOUBLE) ELSE (SELECT level FROM found) * weight END AS target
  FROM levels),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place, s.ticket,
    sum(s.size) OVER (PARTITION BY t.place ORDER BY s.ticket, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, n * source_size + cum AS words, CAST(n * source_size + cum AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS p(n) WHERE size > 0),
taken AS (
  SELECT place, cum, count(*) AS copies
  FROM (SELECT place, cum, sum(size) OVER (ORDER BY finish, place, words ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM passes)
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY place, cum)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(CASE WHEN q.size > 0 THEN coalesce(t.copies, 0) * q.size ELSE 0 END AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.place = t.place AND q.cum = t.cum AND q.size > 0
""",
    "op11_wavelet_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
formed AS (
  SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
worded AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM worded GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
counted AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM worded SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counted c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op8_histogram_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
