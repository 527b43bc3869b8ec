"""Mixing sources to target weights by entropy balancing.

Rates r_d >= 0 per document stay as close as they can (relative entropy over words) to 1
while each source's words reach its target: minimise sum size_d (r_d log r_d - r_d + 1)
subject to sum_{d in s} size_d r_d = target_s. The convex dual has one multiplier per
source, r_d = exp(lambda_s), and is solved by Newton steps whose sums (expected words per
source) are Spark aggregates over (source, size) classes; the multipliers stay a table.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, ...; they share all words by
weight; no target is above ``CAP`` times its source's words and the excess is shared again
by weight among the rest until none is above.

Rates become whole copies: every document gets floor(r) copies; the fractional copies of a
source are given class by class, longest documents first, carrying the rounding remainder
on. The total misses the target by at most half the longest document, and by about half the
shortest where a source has enough documents to take the remainder up. Inside a
class (equal source and size) the documents with the smallest row hash get the extra copy.

Defined cases: null text has size 0; size 0 takes 0; a source whose words are all 0 has
target 0; null source is a source of its own, last; repeated rows count each (equal rows
are interchangeable); empty table gives an empty result; other columns are ignored by
``mix`` and carried by ``replicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import free_names, staged, word_count
from tidewell.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
NEWTON_STEPS = 60
TOLERANCE = 1e-10
RANK_ROWS = 4096       # intended rows of one ranking window


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (skey, source, source_size: one row per source) with column target (double).

    Water filling: sorted by size/weight, a source is capped while cap * size / weight is
    below the level that the remaining words give the remaining weights.
    """
    by_point = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.row_number().over(by_point) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.sum(F.col("source_size").cast("double")).over(whole)
            - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rest_w = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.greatest(rest, F.lit(0.0)) / rest_w
    s = s.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    free = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    return (s.withColumn("free", free)
            .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("free") * F.col("weight")))
            .select("skey", "source", "source_size", "target"))


def newton(classes: DataFrame, goal: DataFrame) -> DataFrame:
    """Multipliers of the dual, (skey, lam), from ``classes`` (skey, size, n) and ``goal``
    (skey, target). Each step sums the expected words of every source over its classes (the
    gradient is words - target, the Hessian is diagonal and equals words)."""
    lam = goal.select("skey", "target", F.lit(0.0).alias("lam"))
    for _ in range(NEWTON_STEPS):
        now = (classes.join(lam, "skey").groupBy("skey")
               .agg(F.sum(F.col("size") * F.col("n") * F.exp("lam")).alias("words"),
                    F.first("lam").alias("lam"), F.first("target").alias("target")))
        live = (F.col("words") > 0) & (F.col("target") > 0)
        newton_step = F.col("target") / F.col("words") - 1
        delta = F.when(live, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), newton_step))).otherwise(0.0)
        now = cut_lineage(now.select("skey", "target", (F.col("lam") + delta).alias("lam"),
                                     F.abs(delta).alias("delta")))
        lam = now.select("skey", "target", "lam")
        if (now.agg(F.max("delta")).first()[0] or 0.0) < TOLERANCE:
            break
    return lam


def _round_source(pdf):
    """Extra copies per class of one source, longest documents first, remainder carried."""
    pdf = pdf.sort_values("size", ascending=False)
    carry, extra = 0.0, []
    for size, n, frac in zip(pdf["size"], pdf["n"], pdf["frac"]):
        want = carry + frac * n * size
        m = int(min(n, max(0, round(want / size)))) if size > 0 and frac > 0 else 0
        carry = want - m * size
        extra.append(m)
    return pdf.assign(extra=extra)[["skey", "size", "n", "base", "extra"]]


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Copies for rows (_id, _hash, source, size): adds source_size, target, copies."""
    skey = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("s:"), F.col("source")))
    docs = docs.withColumn("skey", skey)
    classes = cut_lineage(docs.groupBy("skey", "source", "size").agg(F.count("*").alias("n")))
    sources = classes.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = cut_lineage(targets(sources, weights, cap))
    lam = newton(classes.select("skey", "size", "n"), goal.select("skey", "target"))
    # a rate that Newton left within rounding of a whole number is that number
    rate = F.when(F.col("target") > 0, F.least(F.exp("lam"), F.lit(float(cap)))).otherwise(0.0)
    base = F.floor(F.col("rate") + 1e-9).cast("long")
    rated = (classes.join(lam, "skey").withColumn("rate", rate).withColumn("base", base)
             .withColumn("frac", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
             .select("skey", "size", "n", "base", "frac"))
    rounded = rated.groupBy("skey").applyInPandas(
        _round_source, "skey string, size long, n long, base long, extra long")
    # which documents of a class get the extra copy: ranked by hash, in buckets of bounded size
    docs = docs.join(rounded, ["skey", "size"]).withColumn(
        "bucket", F.pmod(F.col("_hash"), F.greatest(F.lit(1), F.floor(F.col("n") / RANK_ROWS).cast("long"))))
    per = docs.groupBy("skey", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    docs = docs.join(per.drop("in_bucket"), ["skey", "size", "bucket"])
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("_hash", "_id"))
    copies = F.col("base") + F.when(F.col("before") + rank <= F.col("extra"), 1).otherwise(0)
    docs = docs.withColumn("copies", copies)
    return docs.join(goal.select("skey", "source_size", "target"), "skey")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, carry=()) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                     word_count(F.col(text_col)).alias("size"),
                     F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col)).alias("_hash"), *carry)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row."""
    d = plan(staged(_sized(df, id_col, text_col, source_col)), weights, cap)
    return d.select(F.col("_id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def replicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: the input's columns, each document as often as it is taken, numbered from
    1 in a further column ``copy`` (``copy_`` where the input has a ``copy``). Documents are
    joined to their plan by (id, hash); equal rows of a repeated document share their copies."""
    names = df.columns
    pid, phash, psource, taken, row_hash, copy = free_names(df, "_pid", "_phash", "_psource", "_copies", "_phash2", "copy")
    p = plan(staged(_sized(df, id_col, text_col, source_col)), weights, cap)
    p = (p.groupBy(F.col("_id").alias(pid), F.col("_hash").alias(phash), F.col("source").alias(psource))
         .agg(F.sum("copies").alias(taken)).filter(F.col(taken) > 0))
    one = df.withColumn(row_hash, F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col))).dropDuplicates(
        [id_col, row_hash, source_col])
    cond = (F.col(id_col).eqNullSafe(F.col(pid)) & (F.col(row_hash) == F.col(phash))
            & F.col(source_col).eqNullSafe(F.col(psource)))
    return one.join(p, cond).select(*[F.col(f"`{c}`") for c in names],
                                    F.explode(F.sequence(F.lit(1).cast("long"), F.col(taken))).alias(copy))
