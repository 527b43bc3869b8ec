"""Exact dedup: tree merge of digest runs in rounds (DataFrame functions only).

Every row becomes a digest row: SHA-256 of the text with white-space runs replaced by one
space, plus an independent check (64-bit xxHash and byte length of the same text). Rows are
dealt to ``FAN_IN ** levels`` runs by a hash of the row. A task sorts its rows by (run, digest)
and combines equal neighbours: sorted digest runs. In each round (run number divided by a power of
``FAN_IN``: sixteen runs become one, which is four binomial rounds in one exchange) the runs are
exchanged by digest and run, put in order and merged in one pass over neighbours: the smallest
(is the id null, id) is kept, the counts are added and the check values compared, so a digest that
stood for two different texts raises instead of merging them. After the last round one row per
digest is left. Spark does this by sort aggregates, asserted in a test: the least of a struct has
no hash aggregate. Memory is that of an external sort.
The answer travels back down the same tree, one level per join, so no join key ever gathers more
than ``FAN_IN`` rows of a level (the last level: the rows of one run), however many copies a text
has.

Defined cases: null text counts as empty text; empty texts form one group; null doc_ids
sort after all others (they are kept only if the whole group has none); rows that repeat a
doc_id and text each get a row, and with equal smallest doc_ids exactly the rows carrying
that id have kept = true in ``assign``; ``deduplicate`` keeps one of them. An empty table
gives an empty result. Columns of the input other than id and text are ignored by
``assign`` and carried unchanged by ``deduplicate``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE_RUN, free_names, staged

FAN_IN = 16            # runs merged by one step of a round
RUN_ROWS = 1 << 18     # intended rows per first-level run


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """One digest row per input row; ``carry`` columns are kept as they are."""
    t = normalised(F.col(text_col))
    return df.select(F.col(id_col).alias("_id"), F.sha2(t.cast("binary"), 256).alias("_sha"),
                     F.xxhash64(t).alias("_check"), F.octet_length(t).cast("long").alias("_len"),
                     *[F.col(c) for c in carry])


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """One merging step over rows in the order of ``keys``: least ``_first`` (is the id null, id)
    and count per key; differing check values raise."""
    out = df.groupBy(*keys).agg(
        F.min("_first").alias("_first"), F.sum("_n").alias("_n"),
        F.min("_check_lo").alias("_check_lo"), F.max("_check_hi").alias("_check_hi"),
        F.min("_len_lo").alias("_len_lo"), F.max("_len_hi").alias("_len_hi"))
    same = (F.col("_check_lo") == F.col("_check_hi")) & (F.col("_len_lo") == F.col("_len_hi"))
    verified = F.when(same, F.col("_n")).otherwise(
        F.raise_error(F.lit("two different texts share a digest")).cast("long"))
    return out.withColumn("_n", verified)


def levels_for(rows: int) -> int:
    return max(1, math.ceil(math.log(max(rows, 1) / RUN_ROWS, FAN_IN)) + 1) if rows > RUN_ROWS else 1


def resolve(dig: DataFrame, levels: int) -> DataFrame:
    """Adds ``_first`` (smallest id of the row's group) and ``_n`` (group size) to digest rows."""
    runs = FAN_IN ** levels
    dig = dig.withColumn("_run", F.pmod(F.xxhash64("_id", "_sha", F.lit(17)), F.lit(runs)))
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    level = _merge(dig.select("_run", "_sha", first.alias("_first"), F.lit(1).cast("long").alias("_n"),
                              F.col("_check").alias("_check_lo"), F.col("_check").alias("_check_hi"),
                              F.col("_len").alias("_len_lo"), F.col("_len").alias("_len_hi")), ["_run", "_sha"])
    up = [level]
    for _ in range(levels):
        level = level.withColumn("_run", F.floor(F.col("_run") / FAN_IN).cast("long"))
        level = _merge(level, ["_run", "_sha"])
        up.append(level)
    answer = up[-1].select("_sha", "_run", F.col("_first.id").alias("_min"), F.col("_n").alias("_total"))
    for below in reversed(up[:-1]):
        parent = answer.withColumnRenamed("_run", "_up")
        answer = (below.select("_sha", "_run", F.floor(F.col("_run") / FAN_IN).cast("long").alias("_up"))
                  .join(parent, ["_sha", "_up"]).select("_sha", "_run", "_min", "_total"))
    return dig.join(answer.withColumnRenamed("_min", "_first").withColumnRenamed("_total", "_n"),
                    ["_sha", "_run"])


def _resolved(df: DataFrame, id_col: str, text_col: str, carry=()) -> DataFrame:
    dig = staged(digests(df, id_col, text_col, carry))
    return resolve(dig, levels_for(dig.count()))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    r = _resolved(df, id_col, text_col)
    return r.select(F.col("_id").alias("doc_id"), F.col("_first").alias("keep_id"),
                    F.col("_n").alias("group_size"),
                    F.col("_id").eqNullSafe(F.col("_first")).alias("kept"),
                    F.col("_sha").alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with one row left of each group of equal texts.

    The digest row of the surviving id is found by the tree; the documents themselves are
    joined to the survivors by (id, digest), a key of one row each.
    """
    row_sha, keep_id, keep_sha = free_names(df, "_row_sha", "_keep_id", "_keep_sha")
    r = _resolved(df, id_col, text_col)
    keep = (r.filter(F.col("_id").eqNullSafe(F.col("_first")))
            .select(F.col("_id").alias(keep_id), F.col("_sha").alias(keep_sha)).distinct())
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    names = df.columns
    # rows that repeat both id and text: one of them stays
    rows = df.select(*[F.col(f"`{c}`") for c in names], sha.alias(row_sha))
    out = rows.join(keep, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(row_sha) == F.col(keep_sha)),
                    "left_semi")
    return out.dropDuplicates([id_col, row_sha]).select(*[F.col(f"`{c}`") for c in names])
