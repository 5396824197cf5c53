"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file's place: the folder in ADDRLOOM_TOKENIZERS, else the installed package of them."""
    if folder := os.environ.get("ADDRLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from . import store

    store.text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import knn

    rows = table(spark, sf_dir, "embeddings")
    return knn.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.media_digest(media.text_media(table(spark, sf_dir, "documents")))


def op3_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    return lm.score_documents(docs, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.select("doc_id", quality.grade_of_labels().alias("grade")))
    return quality.grade(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_probability", "keep")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SHARD_BYTES = 4 << 20


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents"), ["doc_id"], F.octet_length("text"), SHARD_BYTES)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    kept = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resample

    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), 25, 20, 7)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import interactions

    return interactions.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_source_mixing, op3_kneser_ney_scoring, op4_quality_classifier, op5_voronoi_topk, op6_media_columns, op7_simhash_near_dedup, op8_extendible_sharding, op9_line_dedup, op10_suffix_array_dedup, op11_importance_resampling, op12_toxicity, op13_filter_interactions)}


#: Whole inner products over the stated queries, exact as long as they fit 64 bits.
OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP9 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
r AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3), s AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY doc_id
"""


#: Documents by part and failed filters, against every step of every order.
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: [a, b, c, d, e][ord(x) - 64]) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, f, n, good, toxic, fails, NOT list_has_any(fails, before) AS there, list_contains(fails, f) AS bad FROM m, s),
g AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(coalesce(sum(n) FILTER (there AND NOT bad), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (there AND bad), 0) AS BIGINT) AS removed,
CAST(coalesce(sum(n) FILTER (NOT there AND bad), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = [f]), 0) AS BIGINT) AS unique_fails,
CAST(coalesce(sum(good) FILTER (there AND bad), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (there AND bad), 0) AS BIGINT) AS toxic_lost FROM j GROUP BY ALL)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""


def oracle_sql() -> dict[str, str]:
    """Tokens, models, CRC and 64-bit string hashes and media are beyond DuckDB's SQL; the tests hold those against brute force."""
    return {"op5_voronoi_topk": OP5, "op9_line_dedup": OP9, "op13_filter_interactions": OP13}
