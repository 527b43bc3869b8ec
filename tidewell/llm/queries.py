"""Registered queries of the llm operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language_id,
    lm_score,
    mixing,
    near_dedup,
    neighbours,
    substring_dedup,
    token_count,
    toxicity,
    whitening,
)
from tidewell.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def remainder(n: int):
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, share=85)


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    public_tokenizers.path("word_bpe_49k.json"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


_W10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op4_decontaminate", rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W10} AS w FROM benchmark),
q AS (SELECT item, list_slice(w, i, i + least(len(w), 10) - 1) AS win
      FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(win, ' ') AS win, len(win) AS k FROM q),
d AS (SELECT doc_id, row_number() OVER () AS r, {_W10} AS w FROM documents),
p AS (SELECT r, i, n.k, array_to_string(list_slice(w, i, i + n.k - 1), ' ') AS win
      FROM d, (SELECT DISTINCT k FROM win) n, unnest(generate_series(1, len(w) - n.k + 1)) AS u(i)),
m AS (SELECT r, i, p.k, item FROM p JOIN win ON p.win = win.win),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM m, unnest(generate_series(i, i + k - 1)) AS u(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).drop("doc_key")


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder(10) != 0)


@query("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(encode(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train_rule=~held)
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"),
                      toxicity.toxicity_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op8_chat_format", r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
             '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' AS piece FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(md5(piece) ORDER BY pos) AS h FROM p GROUP BY conv_id),
f AS (SELECT conv_id, n_turns, h, array_to_string(h, ',') AS k FROM c),
u AS (SELECT min(conv_id) AS conv_id, k, n_turns, count(*) AS n_copies FROM f GROUP BY k, n_turns),
x AS (SELECT DISTINCT array_to_string(list_slice(h, 1, i), ',') AS k FROM c, unnest(generate_series(1, n_turns - 1)) AS g(i)),
m AS (SELECT conv_id, n_turns, n_copies FROM u WHERE k NOT IN (SELECT k FROM x))
SELECT m.conv_id, (pos - 1) // 512 AS part, m.n_turns, m.n_copies, string_agg(piece, chr(10) ORDER BY pos) AS text
FROM m JOIN p USING (conv_id) GROUP BY m.conv_id, (pos - 1) // 512, m.n_turns, m.n_copies
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder(3) == 1
    model = language_id.train(docs, train_rule=~held)
    out = language_id.identify(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_source_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_hard_negatives", r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
       AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
