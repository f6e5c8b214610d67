"""The queries of this subpackage, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, collision, exact_dedup, filter_audit, hard_negatives, html_text, langid, mixing, packing, pieces, quality, simhash, toxicity
from .common import in_fold, labelled_rows, ship, table


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS hash
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap
  FROM per),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS rate
  FROM weighed WINDOW before AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(rate, cap / w) AS rate FROM filled WHERE rate * w <= cap),
goal AS (SELECT f.source, f.src, f.source_size, round(least(f.cap, coalesce(l.rate * f.w, f.cap)), 6) AS target FROM filled f, level l),
queue AS (
  SELECT s.doc_id, s.source, s.size, s.hash, g.src, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY g.src ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         row_number() OVER () AS rid
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
sent AS (
  SELECT rid, size, (turn * source_size + cum)::DOUBLE / target AS finish, src, hash
  FROM queue, (VALUES (0), (1)) t(turn) WHERE target > 0),
counted AS (
  SELECT rid, size, sum(size) OVER (ORDER BY finish, src, hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM
  (SELECT rid, size, struct_pack(finish := finish, src := src, hash := hash) AS k, finish, src, hash FROM sent)),
taken AS (
  SELECT rid, sum(size) AS taken FROM counted WHERE upto <= (SELECT round(sum(target), 3) FROM goal) GROUP BY rid)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN taken t USING (rid)
"""


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """The lexicon that op2 and the pipeline use: learned from labelled rows outside fold 2 of 4."""
    return toxicity.fitted(labelled_rows(docs, labels, "toxic", ~in_fold("doc_id", 4, 2), toxicity.PER_CLASS))


def fit_quality(docs: DataFrame, labels: DataFrame) -> quality.AdditiveModel:
    """The model that op8 and the pipeline use: learned from labelled rows outside fold 1 of 3."""
    return quality.fitted(labelled_rows(docs, labels, "quality", ~in_fold("doc_id", 3, 1), quality.PER_CLASS))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.padded(packing.packed(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted", "hits")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fit(pages))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenized(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.scored(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fitted(langid.fit_rows(docs, ~in_fold("doc_id", 5, 0)))
    return langid.identified(docs, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(table(spark, sf_dir, "embeddings"))


def op4_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH whole AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT DISTINCT vec_id, embedding, v FROM whole WHERE vec_id % 20 = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.embedding AS asks, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM asked q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, asks ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT d.part, coalesce(quality = 1, false)::INTEGER AS good, coalesce(toxic = 1, false)::INTEGER AS toxic,
         (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
         + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask
  FROM texts d LEFT JOIN known k ON d.doc_id = k.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
  JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INTEGER AS prior
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (prior | own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & prior = 0 AND mask & own <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & prior <> 0 AND mask & own <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & prior = 0 AND mask & own <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & prior = 0 AND mask & own <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, a.v AS asks, c.vec_id, c.label, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
near AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, anchor_label, asks ORDER BY score DESC, vec_id) AS place
  FROM pairs WHERE label = anchor_label),
far AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.asks, p.place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM near p JOIN pairs n ON p.anchor_id = n.anchor_id AND p.anchor_label = n.anchor_label AND p.asks = n.asks AND n.label <> n.anchor_label
  WHERE p.place <= 5 AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_collision": op3_collision,
    "op4_bitsliced": op4_bitsliced,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_pieces": op7_pieces,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_filters": op11_filters,
    "op12_exact": op12_exact,
    "op13_negatives": op13_negatives,
}
SQL: dict[str, str] = {
    "op4_bitsliced": OP4_SQL, "op10_mixing": OP10_SQL, "op11_filters": OP11_SQL, "op12_exact": OP12_SQL, "op13_negatives": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {k: shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
