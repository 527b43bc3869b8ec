"""The bit tables of near-dedup and decontamination: their bits, and what they cost the driver."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, near_dedup
from tidewell.llm.common import importable


def test_driver_gets_no_object_per_word_of_the_table(spark):
    importable(spark)
    n = 400_000                                    # ids in over 300,000 words of the table
    nodes = spark.range(n).select("id", F.col("id").alias("node"), F.col("id").alias("s1"), F.col("id").alias("s2"))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    windows = nodes.select(F.array(F.xxhash64("id")).alias("terms"))
    for make in (lambda: near_dedup._set_table(docs, nodes, "doc_id", "text", 5),
                 lambda: decontaminate._filter_table(windows)):
        make()
        tracemalloc.start()
        try:
            make()
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 6 * near_dedup.FILTER_BITS // 8, peak    # bytes; the table has FILTER_BITS / 8


def test_bits_of_the_table(spark):
    from tidewell.llm.common import bit_table
    bits = 1 << 10
    slots = [0, 0, 63, 64, 127, 500, bits - 1]
    df = spark.createDataFrame([(s,) for s in slots], "s long")

    def set_bits(table):
        return np.flatnonzero(np.unpackbits(table.view(np.uint8), bitorder="little")).tolist()
    table = bit_table(df, F.col("s"), bits)
    assert len(table) == bits // 64 and set_bits(table) == sorted(set(slots))
    assert set_bits(bit_table(df.limit(0), F.col("s"), bits)) == []
