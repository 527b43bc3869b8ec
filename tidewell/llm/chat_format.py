"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold a conversation several times, each snapshot a prefix of the next. Turns are
first reduced to text-free rows: a 128-bit hash that stands for the row, and a 128-bit hash of
(role, text) as rendered. These rows alone are made unique, put in order and hashed; texts are
read again at the end, for the conversations that stay.

Order: the rows are range-partitioned by (conversation, turn, role), so a run, the rows of a
conversation in one partition, is bounded by the partition's size however long the
conversation is. Only rows that share conversation, turn and role are ordered by text; those
rows, and no others, carry it (and its first ``LEAD`` characters into the ranges).
Every turn gets a rolling prefix hash: two 64-bit hashes of (position, role, text), combined
by running XOR inside runs, then over run totals. A conversation whose whole hash equals some
longer conversation's prefix hash of the same length is a snapshot and goes by anti-join; of
equal conversations the smallest conv_id stays. What is left is rendered in parts of ``PART``
turns, so that no cell grows with a conversation.

Format of a turn: ``<|role|>`` new line, text, new line ``<|end|>``, turns joined by a new line.

Defined cases: turns are ordered by (turn, role, text), nulls first, and numbered from 1, so
gaps and ties have one reading; rows that repeat in full (the same conv_id, turn, role and
text) count once; null role renders as ``user``, null text as empty text; rows with null
conv_id form one conversation; an empty table gives an empty result; other columns are
ignored. Equality rests on the 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import staged

LEAD = 256        # characters of a tied text that choose its range
PART = 512        # turns rendered into one row

CONV = ["lost", "conv"]        # a conversation: is conv_id null, and its value


def _two_hashes(names: tuple[str, str], *columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns).alias(name) for seed, name in enumerate(names, 1)]


def _keyed(turns: DataFrame) -> DataFrame:
    """Every input row with its conversation, its hash (id1, id2) and that of its rendering (i1, i2)."""
    zero = F.lit(0).cast(turns.schema["conv_id"].dataType)
    t = turns.select(F.col("conv_id").isNull().alias("lost"), F.coalesce(F.col("conv_id"), zero).alias("conv"),
                     F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    parts = [c for name, fill in (("turn", F.lit(0)), ("role", F.lit("")), ("text", F.lit("")))
             for c in (F.col(name).isNull(), F.coalesce(F.col(name), fill))]
    said = [F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))]
    return t.select("*", *_two_hashes(("id1", "id2"), F.col("lost"), F.col("conv"), *parts),
                    *_two_hashes(("i1", "i2"), *said))


def _ordered(keyed: DataFrame) -> DataFrame:
    """Unique rows without texts, with the run they lie in and the text of tied rows (``tie``)."""
    slim = staged(keyed.drop("text").groupBy("id1", "id2").agg(
        *[F.first(c).alias(c) for c in (*CONV, "turn", "role", "i1", "i2")]))
    tied = slim.groupBy(*CONV, "turn", "role").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    at = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*CONV, "turn", "role")]
    ids = staged(slim.alias("s").join(tied.alias("t"), at, "left_semi").select("id1", "id2"))
    texts = staged(keyed.select("id1", "id2", F.col("text").alias("tie")).join(ids, ["id1", "id2"], "left_semi")
                   .groupBy("id1", "id2").agg(F.first("tie").alias("tie")))
    rows = slim.join(texts, ["id1", "id2"], "left")
    ranged = rows.repartitionByRange(*CONV, "turn", "role", F.substring("tie", 1, LEAD))
    return staged(ranged.withColumn("run", F.spark_partition_id()))


def _before(totals: DataFrame, column: Column) -> Column:
    earlier = Window.partitionBy(*CONV).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(column.over(earlier), F.lit(0))


def prefix_hashes(keyed: DataFrame) -> DataFrame:
    """(conversation, pos, id1, id2) and the rolling prefix hashes p1, p2 of every unique turn."""
    t = _ordered(keyed)
    sizes = t.groupBy(*CONV, "run").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", _before(sizes, F.sum("n"))).drop("n")
    run = Window.partitionBy(*CONV, "run").orderBy("turn", "role", "tie")
    t = (t.join(sizes, [*CONV, "run"]).withColumn("pos", F.col("before") + F.row_number().over(run))
         .select(*CONV, "run", "turn", "role", "tie", "pos", "id1", "id2",
                 F.xxhash64("pos", "i1", "i2").alias("h1"), F.xxhash64("i2", "i1", "pos").alias("h2")))
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    t = staged(t.select(*CONV, "run", "pos", "id1", "id2", F.bit_xor("h1").over(upto).alias("r1"),
                        F.bit_xor("h2").over(upto).alias("r2")))
    # a run's last running value is its total
    totals = t.groupBy(*CONV, "run").agg(F.max(F.struct("pos", "r1", "r2")).alias("e"))
    totals = totals.select(*CONV, "run", _before(totals, F.bit_xor("e.r1")).alias("b1"),
                           _before(totals, F.bit_xor("e.r2")).alias("b2"))
    return t.join(totals, [*CONV, "run"]).select(
        *CONV, "pos", "id1", "id2", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"),
        F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conversation, n_turns, n_copies) of those that are no prefix of a longer one and no copy."""
    whole = hashed.groupBy(*CONV).agg(F.max(F.struct("pos", "p1", "p2")).alias("e")).select(
        *CONV, F.col("e.pos").alias("n_turns"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2"))
    # one row per distinct conversation, then one per distinct proper prefix
    unique = whole.groupBy("n_turns", "p1", "p2").agg(F.min(F.struct(*CONV)).alias("c"), F.count("*").alias("n_copies"))
    last = whole.select(*CONV, F.col("n_turns").alias("len"))
    proper = (hashed.select(*CONV, "pos", "p1", "p2").join(last, CONV).filter("pos < len")
              .select(F.col("pos").alias("n_turns"), "p1", "p2").distinct())
    kept = unique.join(proper, ["n_turns", "p1", "p2"], "left_anti")
    return kept.select("c.lost", "c.conv", "n_turns", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the conversation), n_copies, text: the maximal
    conversations, rendered."""
    keyed = _keyed(turns)
    hashed = staged(prefix_hashes(keyed))
    places = hashed.join(maximal(hashed), CONV).select(*CONV, "pos", "id1", "id2", "n_turns", "n_copies")
    piece = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("user")), F.lit("|>\n"),
                     F.coalesce(F.col("text"), F.lit("")), F.lit("\n<|end|>"))
    # texts join by row hash: repeats combine before they move, and no key holds many rows
    pieces = keyed.select("id1", "id2", piece.alias("piece")).groupBy("id1", "id2").agg(F.first("piece").alias("piece"))
    rows = places.join(pieces, ["id1", "id2"]).select(
        *CONV, "n_turns", "n_copies", F.floor((F.col("pos") - 1) / PART).cast("long").alias("part"),
        F.struct("pos", "piece").alias("turn"))
    out = rows.groupBy(*CONV, "part").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                                          F.sort_array(F.collect_list("turn")).alias("turns"))
    return out.select(F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "part", "n_turns", "n_copies",
                      F.array_join(F.col("turns.piece"), "\n").alias("text"))
