"""Benchmark decontamination with a distributed positional inverted index.

Index: documents are cut into blocks of about 4 MB of text. A block has a directory row (its
documents and where each begins in the block's word stream) and one row per term with the
term's positions in that stream. Only terms that may occur in the benchmark are posted: a
bit table of fixed size (``FILTER_BITS``), set for every benchmark term, is what the tasks
get, so nothing that is broadcast grows with either table; a false positive only posts a
term nobody asks for. The index is written to the checkpoint folder.

Query: a benchmark text gives windows of ``WINDOW`` consecutive words (a shorter one gives
itself). The index's posting counts pick each window's rarest term; windows with a term
that was never posted cannot match. Windows meet the blocks that hold their rarest term
(an equality join on the term), and inside a block the lists are intersected from the
rarest term on, each shifted by its offset. With ``slop`` 0 the matches are exact phrases;
with slop s every other term may stand up to s positions from its place (proximity).

A term is its 64-bit hash; two different words of one window position would have to share
it to make a false match. Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: null and empty texts have no words, no windows and no hits; repeated
documents are each marked; repeated items count once by item_id, and equal windows of
several items count for each; null item_ids count for hits but not in the item list; an
empty benchmark marks nothing, an empty document table gives an empty result; other
columns are ignored by ``mark`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import arrow_words as A
from tidewell.llm.common import bit_table, free_names, importable, staged, text_slices

WINDOW = 10
FILTER_BITS = 1 << 26
_INDEX = "block string, term long, n long, post binary, ids array<long>, keys array<long>, first array<long>"
_MARKS = ("doc_id long, doc_key long, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean")


def _words(texts: pa.Array):
    w = A.find_words(texts, A.PUNCT, lower=True)
    return w, A.word_hash(w).view(np.int64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(13)) & np.uint64(FILTER_BITS - 1)


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, terms): every window of every benchmark text."""
    def cut(batches):
        for batch in text_slices(batches, "text"):
            w, h = _words(batch.column("text"))
            ids, out_i, out_t = batch.column("item"), [], []
            for r in range(w.rows):
                v = h[w.first[r]:w.first[r + 1]]
                for k in range(max(1, len(v) - size + 1) if len(v) else 0):
                    out_i.append(r)
                    out_t.append(v[k:k + size])
            if out_i:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out_i, pa.int64())), pa.array(out_t, pa.list_(pa.int64()))], ["item", "terms"])
    return (items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
            .mapInArrow(cut, "item string, terms array<long>").distinct())


def _filter_table(windows: DataFrame) -> np.ndarray:
    """The bit table of all benchmark terms (FILTER_BITS / 64 words)."""
    slot = F.shiftright(F.col("t"), 13).bitwiseAND(FILTER_BITS - 1)
    return bit_table(windows.select(F.explode("terms").alias("t")).distinct(), slot, FILTER_BITS)


def build_index(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    bits = docs.sparkSession.sparkContext.broadcast(wanted)     # FILTER_BITS / 8 bytes

    def post(batches):
        asked = np.unpackbits(bits.value.view(np.uint8), bitorder="little").view(bool)
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(text_slices(batches, "text")):
            w, h = _words(batch.column("text"))
            block = f"{part}-{k}"
            at = np.flatnonzero(asked[_slot(h)])
            order = np.argsort(h[at], kind="stable")
            terms, pos = h[at][order], at[order].astype(np.uint32)
            cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
            ends = np.append(cut[1:], len(terms))
            n = len(cut)
            none = [None] * n
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (n + 1)), pa.array([None, *terms[cut].tolist()], pa.int64()),
                pa.array([None, *(ends - cut).tolist()], pa.int64()),
                pa.array([None, *[pos[a:b].tobytes() for a, b in zip(cut, ends)]], pa.binary()),
                pa.array([batch.column("id").to_pylist(), *none], lists),
                pa.array([batch.column("key").to_pylist(), *none], lists),
                pa.array([w.first.tolist(), *none], lists)],
                ["block", "term", "n", "post", "ids", "keys", "first"])
    return staged(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"),
                              F.col(text_col).alias("text")).mapInArrow(post, _INDEX))


def _near(lists: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """For each wanted position: is there one in the sorted list within ``slop``?"""
    at = np.searchsorted(lists, want - slop)
    return (at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] <= want + slop)


def _intersect(slop: int):
    def block_marks(index: pa.Table, windows: pa.Table) -> pa.Table:
        lists, directory = {}, None
        for term, post, row in zip(index["term"].to_pylist(), index["post"].to_pylist(), range(index.num_rows)):
            if term is None:
                directory = row
            else:
                lists[term] = np.frombuffer(post, np.uint32).astype(np.int64)
        first = np.array(index["first"][directory].as_py(), dtype=np.int64)
        ids, keys = index["ids"][directory].as_py(), index["keys"][directory].as_py()
        cover = np.zeros(first[-1] + 1, dtype=np.int64)
        found: dict[int, set] = {}
        for terms, off, items in zip(windows["terms"].to_pylist(), windows["rare_at"].to_pylist(), windows["items"].to_pylist()):
            if any(t not in lists for t in terms):
                continue
            start = lists[terms[off]] - off
            doc = np.searchsorted(first, start + off, side="right") - 1
            start = start[(start >= first[doc]) & (start + len(terms) <= first[doc + 1])]
            for k in sorted(range(len(terms)), key=lambda k: len(lists[terms[k]])):
                if not len(start):
                    break
                if k != off:
                    start = start[_near(lists[terms[k]], start + k, slop)]
            if len(start):
                np.add.at(cover, start, 1)
                np.add.at(cover, start + len(terms), -1)
                for d in np.unique(np.searchsorted(first, start, side="right") - 1).tolist():
                    found.setdefault(d, set()).update(x for x in items if x is not None)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        n_hit = hit[first[1:]] - hit[first[:-1]]
        listed = [sorted(found.get(d, ())) for d in range(len(ids))]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "doc_key": pa.array(keys, pa.int64()),
            "n_words": pa.array(np.diff(first)), "n_hit": pa.array(n_hit),
            "n_items": pa.array([len(x) for x in listed], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
            "contaminated": pa.array(n_hit > 0)})
    return block_marks


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, doc_key (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated."""
    importable(docs.sparkSession)
    windows = staged(benchmark_windows(items, item_col, item_text_col, size))
    index = build_index(docs, _filter_table(windows), id_col, text_col)
    counts = index.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    asked = windows.groupBy("terms").agg(F.collect_set("item").alias("items"))
    parts = (asked.select("terms", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left"))
    rarest = (parts.groupBy("terms").agg(F.min(F.struct(F.col("n"), F.col("at"), F.col("term"))).alias("r"),
                                         F.count("n").alias("known"))
              .filter(F.col("known") == F.size("terms"))
              .select("terms", F.col("r.at").alias("rare_at"), F.col("r.term").alias("rare")))
    rarest = rarest.join(asked, "terms")
    meets = (index.filter("term is not null").select(F.col("block").alias("at_block"), F.col("term").alias("rare"))
             .join(rarest, "rare").select("at_block", "terms", "rare_at", "items"))
    return index.groupBy("block").cogroup(meets.groupBy("at_block")).applyInArrow(_intersect(slop), _MARKS)


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents without a hit, all columns kept (equal rows share their mark)."""
    bad_id, bad_key = free_names(docs, "_bad_id", "_bad_key")
    bad = (mark(docs, items, id_col, text_col, **kw).filter("contaminated")
           .select(F.col("doc_id").alias(bad_id), F.col("doc_key").alias(bad_key)).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id))
                     & (F.xxhash64(F.col(text_col)) == F.col(bad_key)), "left_anti")
