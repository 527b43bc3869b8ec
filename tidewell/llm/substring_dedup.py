"""Substring dedup on a sparse de Bruijn graph of word k-mers.

Graph: nodes are the ``K``-mers of words that are the least (by hash) of the K-mers inside
some window of ``WINDOW`` words, so every window holds its own node and equal windows hold
equal nodes at equal places; an edge joins a document's consecutive nodes and is named by
the hash of all words from the first to the end of the second. One exchange of packed node
keys (``blocks``) tells each block, per node, whether it occurs elsewhere, where it occurs
first, and whether all occurrences share their incoming and their outgoing edge. Where they
do, the path through the node does not branch: the windows that lie between the node's
neighbours repeat exactly as the node does, and a whole unbranched path is settled by its
nodes without any row per window. Windows at branches and path ends are settled by a second
exchange of their own 128-bit hashes with source coordinates. A window whose words also
start earlier (smaller doc_id, or earlier in the document) is repeated, and the words under
repeated windows are removed.

No path is compacted and no span is compared at its source coordinates: each window is
settled from its node's flags, or by the exchange of window hashes.

Equality rests on hashes. A node is matched by 64 bits of one word hash and an edge by 64
bits of a second, independent one, so a closed window has 128 bits on the node's words and
the edge's 64 on the others; windows at branches are matched by 128 bits, 64 of each. A node is never matched alone except where its window ends with it, where the window
hashes decide.

Defined cases: null, empty and short texts (under ``WINDOW`` words) lose nothing; null ids
come after all others; rows that repeat an id are ordered by their block and place, the
later loses its repeats; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import arrow_words as A
from tidewell.llm import blocks as B

WINDOW = 20
K = 8
_BASE = int(A.constants(1, 301)[0])


def _span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the words from s to before e; never 0, which stands for "several"."""
    up, down = A._powers(_BASE, len(h) + 1)
    acc = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:len(h)], out=acc[1:])
    return A.mix((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64) * A.constants(1, 302)[0]) | np.uint64(1)


class Block:
    """Words, windows and nodes of one block; the same at every reading."""

    def __init__(self, data: bytes, window: int):
        t = B.unpack(data)
        self.ids, self.window = t["id"].combine_chunks() if t.num_rows else pa.array([], pa.int64()), window
        self.w = A.find_words(t["text"])
        h, second = A.word_hash(self.w, 1), A.word_hash(self.w, 2)
        self.h, self.second = h, second
        self.span = window - K + 1
        self.ok = np.flatnonzero(A.remaining(self.w) >= window)            # window starts
        if len(self.ok):
            kmer = A.window_hash(h, K, 303)
            self.least = A.leftmost_min(np.concatenate([kmer, np.full(self.span - 1, ~np.uint64(0))]), self.span)[self.ok]
            self.node = np.unique(self.least)                                # word positions of nodes
            doc = self.w.row[self.node]
            k = len(self.node)
            linked = np.zeros(k, bool)
            linked[1:] = doc[1:] == doc[:-1]
            prev = np.where(linked, np.concatenate([[0], self.node[:-1]]), -1)
            nxt = np.where(np.append(linked[1:], False), np.append(self.node[1:], 0), -1)
            at = np.maximum(prev, 0)
            self.into = np.where(prev >= 0, _span_hash(second, at, np.where(prev >= 0, self.node + K, at)), np.uint64(0))
            self.out = np.where(nxt >= 0, _span_hash(second, self.node, np.where(nxt >= 0, nxt + K, self.node)), np.uint64(0))
            self.prev, self.next = prev, nxt
            self.key, self.first, self.of = np.unique(kmer[self.node], return_index=True, return_inverse=True)
        else:
            self.least = self.node = np.zeros(0, np.int64)
            self.key, self.first, self.of = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.into = self.out = np.zeros(0, np.uint64)

    def doc_ids(self, rows: np.ndarray) -> np.ndarray:
        """Ids of text rows, null as the largest."""
        ids = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        return ids[rows]

    def node_request(self):
        """(key, only incoming edge or 0, only outgoing edge or 0, first doc, several here)."""
        n = len(self.key)

        def only(edge):
            lo, hi = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
            np.minimum.at(lo, self.of, edge)
            np.maximum.at(hi, self.of, edge)
            return np.where(lo == hi, hi, np.uint64(0))
        return self.key, only(self.into), only(self.out), self.doc_ids(self.w.row[self.node[self.first]])

    def settle(self, flags: np.ndarray):
        """Of each window: repeated earlier (settled), and the windows left open."""
        p = np.searchsorted(self.node, self.least)                # node of each window
        key = self.of[p]
        several = np.bincount(self.of, minlength=len(self.key))[key] > 1
        f = flags[key]
        repeated = several | ((f & 1) > 0)
        start, end = self.ok, self.ok + self.window
        left = (start >= self.least) | (((f & 4) > 0) & (self.prev[p] >= 0) & (start >= self.prev[p]))
        right = (end <= self.least + K) | (((f & 8) > 0) & (self.next[p] >= 0) & (end <= self.next[p] + K))
        closed = repeated & left & right
        earlier = ((f & 2) > 0) | (self.first[key] != p)
        return closed & earlier, np.flatnonzero(repeated & ~closed)

    def open_request(self, at: np.ndarray):
        """Distinct windows among the open ones: (hash, second hash, first doc), and each
        open window's place among them."""
        h1, h2 = self._window_hashes()
        pair = np.empty(len(at), dtype=[("a", np.uint64), ("b", np.uint64)])
        pair["a"], pair["b"] = h1[self.ok[at]], h2[self.ok[at]]
        order = np.lexsort((self.ok[at], pair["b"], pair["a"]))
        s = pair[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        of = np.empty(len(s), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        return s["a"][new], s["b"][new], self.doc_ids(self.w.row[self.ok[at][first]]), of, first

    def _window_hashes(self):
        return A.window_hash(self.h, self.window, 305), A.window_hash(self.second, self.window, 306)


def _merge_nodes(cols, block):
    key, into, out, doc = cols
    order = np.lexsort((block, doc, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(k)))

    def shared(edge):
        e = edge[order]
        return (np.minimum.reduceat(e, begin) == np.maximum.reduceat(e, begin)) & (e[begin] != 0)
    flag = np.zeros(len(k), np.uint8)
    flag |= (n > 1)[group].astype(np.uint8)
    flag |= (~new).astype(np.uint8) << 1                           # another block has it first
    flag |= shared(into)[group].astype(np.uint8) << 2
    flag |= shared(out)[group].astype(np.uint8) << 3
    back = np.empty(len(k), np.uint8)
    back[order] = flag
    return [back]


def _merge_windows(cols, block):
    a, b, doc = cols
    order = np.lexsort((block, doc, b, a))
    same = np.zeros(len(a), bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    back = np.empty(len(a), np.uint8)
    back[order] = same
    return [back]


def _side(t: pa.Table, kind: int) -> pa.Table:
    import pyarrow.compute as pc
    return t.filter(pc.equal(t["kind"], kind)) if t.num_rows else t


def _removed(block: Block, t: pa.Table, buckets: int) -> np.ndarray:
    """Repeated windows of the block from both kinds of answers."""
    hit = np.zeros(len(block.ok), bool)
    if not len(block.ok):
        return hit
    flags = B.collected(_side(t, 1), block.key, buckets)[0]
    hit, at = block.settle(flags)
    if len(at):
        a, b, _, of, first = block.open_request(at)
        earlier = B.collected(_side(t, 2), a, buckets)[0] > 0
        place = np.arange(len(at))
        hit[at] = earlier[of] | (first[of] != place)
    return hit


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row."""
    packed = B.pack(docs, id_col, text_col)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = B.bucket_count(total, 0.03)

    def ask_nodes(batches):
        for batch in batches:
            for name, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                block = Block(data.as_py(), window)
                key, *rest = block.node_request()
                yield B.dealt(name, key, buckets, *rest)
    nodes = B.staged(B.answers(packed.select("block", "data").mapInArrow(ask_nodes, B.REQUEST), _merge_nodes))

    def ask_open(text: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for name, data in zip(text["block"].to_pylist(), text["data"]):
            block = Block(data.as_py(), window)
            if len(block.ok):
                _, at = block.settle(B.collected(got, block.key, buckets)[0])
                if len(at):
                    a, b, doc, _, _ = block.open_request(at)
                    out.append(B.dealt(name, a, buckets, b, doc))
        return pa.Table.from_batches(out) if out else pa.table(
            {"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.string()), "data": pa.array([], pa.binary())})
    answer = nodes.select(F.col("block").alias("to"), "bucket", "data")
    asked = packed.select("block", "data").groupBy("block").cogroup(answer.groupBy("to")).applyInArrow(ask_open, B.REQUEST)
    windows = B.answers(asked, _merge_windows)

    def finish(text: pa.Table, got: pa.Table) -> pa.Table:
        done = []
        for data in text["data"]:
            block = Block(data.as_py(), window)
            done.append(_result(block, _removed(block, got, buckets), with_text))
        return pa.concat_tables(done)
    both = (nodes.select(F.col("block").alias("to"), F.lit(1).alias("kind"), "bucket", "data")
            .unionByName(windows.select(F.col("block").alias("to"), F.lit(2).alias("kind"), "bucket", "data")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return packed.select("block", "data").groupBy("block").cogroup(both.groupBy("to")).applyInArrow(finish, schema)


def _result(block: Block, hit: np.ndarray, with_text: bool) -> pa.Table:
    w = block.w
    n = len(w.start)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, block.ok[hit], 1)
    np.add.at(cover, block.ok[hit] + block.window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    lost = np.concatenate([[0], np.cumsum(gone)])
    kept = np.flatnonzero(~gone)
    row = w.row[kept]
    lead = np.zeros(len(kept), bool)                    # first kept word of its text
    lead[:1] = True
    lead[1:] = row[1:] != row[:-1]
    text = np.where(A.SPACE[w.buf], np.uint8(32), w.buf) if len(w.buf) else w.buf
    mark = np.zeros(len(w.buf) + 1, np.int8)
    start = w.start[kept] - ~lead                       # with the one white-space byte before it
    np.add.at(mark, start, 1)
    np.add.at(mark, w.end[kept], -1)
    out = text[np.cumsum(mark, dtype=np.int8)[:-1] > 0].tobytes()
    size = np.zeros(w.rows, np.int64)
    np.add.at(size, row, w.end[kept] - start)
    cut = np.concatenate([[0], np.cumsum(size)])
    parts = [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    t = {"doc_id": block.ids, "n_words": pa.array(w.counts.astype(np.int64)),
         "n_removed": pa.array((lost[w.first[1:]] - lost[w.first[:-1]]).astype(np.int64)),
         "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())}
    if with_text:
        t["kept_text"] = pa.array([p.decode("utf-8") for p in parts], pa.string())
    return pa.table(t)
