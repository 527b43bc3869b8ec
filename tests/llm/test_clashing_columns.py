"""Operators that keep the input's columns, with every helper name as an input column."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, exact_dedup, mixing, near_dedup
from tidewell.llm.common import free_names, importable

HELPERS = ["_row_sha", "_keep_id", "_keep_sha", "_bad_id", "_bad_key", "_gone", "_gone_key", "_again", "_again_key",
           "_same_id", "_same_key", "_pid", "_phash", "_psource", "_copies", "_phash2", "copy", "_id", "_sha", "_hash",
           "key", "id", "block", "n", "Copy2", "skey", "size", "bucket"]
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG + " x", "b"), (4, "other words here", None),
            (None, None, "b"), (5, "bench item text " * 4, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(i).alias(h) for i, h in enumerate(HELPERS)])


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_filters_keep_columns(spark, docs):
    items = spark.createDataFrame([("q", "bench item text")], "item_id string, text string")
    for out, want in ((exact_dedup.deduplicate(docs), [1, 3, 4, 5]), (near_dedup.keep_representatives(docs), [1, 4, 5]),
                      (decontaminate.remove_contaminated(docs, items), [1, 2, 2, 3, 4])):
        assert out.columns == docs.columns
        assert ids(out) == [(False, i) for i in want] + [(True, 0)]


def test_replicate_numbers_copies_beside_a_copy_column(docs):
    out = mixing.replicate(docs)
    assert out.columns == [*docs.columns, "copy_"] and out.count() > 0
    assert out.select("copy").distinct().count() == 1 and out.agg(F.min("copy_")).first()[0] == 1


def test_free_names(docs):
    assert free_names(docs, "_gone", "COPY2", "new", "new") == ["_gone_", "COPY2_", "new", "new_"]


def test_near_duplicates_kept_by_contract(spark):
    near = LONG.replace("seven", "seven") + " fifteen"
    df = spark.createDataFrame([(4, LONG * 20), (4, LONG * 20 + " x"), (9, LONG * 20), (7, near)], "doc_id long, text string")
    for r in near_dedup.near_duplicates(df).collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(r["kept"] for r in near_dedup.near_duplicates(df).filter("doc_id = 4").collect()) == [True, True]
