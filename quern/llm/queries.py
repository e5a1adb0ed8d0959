"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import load

from . import class_lm, quality
from .embedding_dedup import near_embeddings
from .exact_dedup import exact_dedup
from .html_text import main_text
from .mixing import mix
from .near_dedup import near_dedup
from .packing import best_fit_packing
from .secrets import secret_scan, span_digest
from .toxicity import score_toxicity, train


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secret_scan(load(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, load(spark, sf_dir, "labels")))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return class_lm.score_lm(docs, *class_lm.train(docs))


def op4_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(load(spark, sf_dir, "embeddings"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_class_lm, op4_co_training_quality, op5_exact_dedup, op6_embedding_near_dedup, op7_html_main_text, op8_source_mixing, op9_best_fit_packing, op10_minhash_near_dedup)}

#: Pairs of documents by the shingles they share, then the least id that reaches each along the links.
NEAR_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words] ELSE list_transform(range(1, len(words) - 3), lambda k: words[k : k + 4]) END) AS shingle FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
        m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""

ORACLE_SQL = {
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
            n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
            r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached),
            m AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1)
        SELECT x.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, x.vec_id = m.component_id AS kept FROM embeddings x LEFT JOIN n ON n.a = x.vec_id JOIN m ON m.vec_id = x.vec_id""",
    "op10_minhash_near_dedup": NEAR_SQL,
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (t)""",
}
