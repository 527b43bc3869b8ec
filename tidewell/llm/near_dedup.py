"""MinHash near-dedup by a multi-index Hamming join.

Sets: distinct word shingles per text (hashed to 64 bits). Texts with the same set are one
class (128-bit set digest); the join works on classes, so copies never pair up. Signature:
``SYMBOLS`` minhash values of ``BITS`` bits. The signature is split into chunks of
``CHUNK`` symbols; every chunk is indexed under each way of having one wrong symbol (the
three others as key), so two signatures share a key unless every chunk has two errors.
By pigeonhole all pairs within ``2 * chunks - 1`` (23) wrong symbols of 48 are found; a pair
at the similarity threshold of 0.85 has 7.2 expected errors and is beyond 23 with a
probability below 1e-7.

Links are wanted as components, so a bucket is not paired up: first every class meets the
most central member of its buckets (the one sharing most keys), and the closest of these
pairs is confirmed on full sets. What then still spans several components of a bucket is
compared signature by signature inside the bucket (large buckets in pairs of blocks, spread
over tasks). Classes with a partner of another component within the signature distance go
to a cell, their component or that of their closest centre, and all pairs of different
components are tried there on full sets over an index of the cell's shingles. A class with
such a partner in a larger cell visits that cell; so members travel once to each cell they
have a partner in, not in pairs. Blocks of a cell and parts of confirmed pairs are bounded by rows and by
the bytes of their sets. Pairs inside one component need no check, so no link between different
texts is lost but those beyond the signature distance (above).

Defined cases: null, empty and blank texts have an empty set, link with nothing and are kept;
texts with fewer words than a shingle have their whole word sequence as one shingle; null
ids act as larger than all others; rows repeating an id are separate documents, of which
the one with the smallest text hash is kept if their id is the component's smallest; an empty
table gives an empty result; other columns are ignored by ``near_duplicates`` and kept by
``keep_representatives``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewell.llm import arrow_words as A
from tidewell.llm.common import bit_table, free_names, importable, staged, text_slices
from tidewell.llm.components import connected_components

SYMBOLS, CHUNK, BITS = 48, 4, 16
CHUNKS = SYMBOLS // CHUNK
MAX_ERRORS = 2 * CHUNKS - 1
CELL = 2048
SET_BYTES = 4096         # a group of sets counts as many rows as it has bytes / SET_BYTES, if those are more
FILTER_BITS = 1 << 26
_MULT, _XOR = A.constants(SYMBOLS, 501), A.constants(SYMBOLS, 502)
_FEATURES = "id long, key long, n_shingles long, s1 long, s2 long, sig binary"


def shingle_sets(texts: pa.Array, size: int):
    """(sorted distinct shingles, first shingle of each text)."""
    w = A.find_words(texts, lower=True)
    h = A.word_hash(w, 1)
    left, n = A.remaining(w), w.counts
    full = np.flatnonzero(left >= size)
    value, row = [A.window_hash(h, size, 510)[full]], [w.row[full]]
    for k in range(1, size):                       # texts of k words: one shingle of k words
        short = np.flatnonzero(n == k)
        value.append(A.window_hash(h, k, 510 + k)[w.first[short]])
        row.append(short)
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(w.rows + 1))


def _digests(value: np.ndarray, first: np.ndarray):
    """Two 64-bit set hashes per text."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(A.mix(value ^ c), dtype=np.uint64)]) for c in A.constants(2, 520)]
    return [A.mix(t[first[1:]] - t[first[:-1]]) for t in total]


def features(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches):
        for batch in text_slices(batches, "text"):
            value, first = shingle_sets(batch.column("text"), size)
            n = np.diff(first)
            some = np.flatnonzero(n)
            sig = np.zeros((len(n), SYMBOLS), np.uint16)
            if len(some):
                at = first[:-1][some]
                for k in range(SYMBOLS):
                    low = np.minimum.reduceat((value ^ _XOR[k]) * _MULT[k], at)
                    sig[some, k] = (A.mix(low) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
            s1, s2 = _digests(value, first)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("key"), pa.array(n.astype(np.int64)),
                pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                pa.array([v.tobytes() if k else None for v, k in zip(sig, n)], pa.binary())],
                ["id", "key", "n_shingles", "s1", "s2", "sig"])
    return staged(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"),
                              F.col(text_col).alias("text")).mapInArrow(run, _FEATURES))


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches):
    """Each chunk under each choice of one wrong symbol."""
    seed = A.constants(SYMBOLS, 530)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signatures(batch.column("sig")).astype(np.uint64)
        out = []
        for c in range(CHUNKS):
            s = sig[:, c * CHUNK:(c + 1) * CHUNK]
            for o in range(CHUNK):
                three = np.delete(s, o, axis=1)
                packed = three[:, 0] | (three[:, 1] << np.uint64(16)) | (three[:, 2] << np.uint64(32))
                out.append(A.mix(packed ^ seed[c * CHUNK + o]) ^ seed[c * CHUNK + o])
        which = np.repeat(np.arange(SYMBOLS), batch.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out).view(np.int64)), pa.array(which),
             pa.array(np.tile(batch.column("node").to_numpy(), SYMBOLS))], ["key", "which", "node"])


@F.arrow_udf(IntegerType())
def signature_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((_signatures(a) != _signatures(b)).sum(axis=1).astype(np.int32))


def _visits(a, b, node_a, node_b, comp_a, comp_b, cell_a, cell_b, load_a, load_b, which, inside):
    """Two blocks of a bucket: (cell, position) of the members to be tried together. Pairs of
    different components within MAX_ERRORS count, in the first bucket they share: both
    members go to the cell of the one whose cell is larger. Positions in ``b`` are given as
    -1 - position."""
    cells, at = [], []
    step = max(1, (8 << 20) // max(1, len(b) * SYMBOLS))
    for i in range(0, len(a), step):
        same = a[i:i + step, None, :] == b[None, :, :]
        ok = (SYMBOLS - same.sum(axis=2) <= MAX_ERRORS) & (comp_a[i:i + step, None] != comp_b[None, :])
        if inside:
            ok &= node_a[i:i + step, None] < node_b[None, :]
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        chunk = same[x, y].reshape(-1, CHUNKS, CHUNK)
        good = chunk.sum(axis=2)
        c = (good >= CHUNK - 1).argmax(axis=1)
        n = np.arange(len(x))
        o = np.where(good[n, c] == CHUNK, 0, chunk[n, c].argmin(axis=1))
        first = c * CHUNK + o == which
        x, y = i + x[first], y[first]
        to_a = (load_a[x] > load_b[y]) | ((load_a[x] == load_b[y]) & (cell_a[x] < cell_b[y]))
        cell = np.where(to_a, cell_a[x], cell_b[y])
        both = np.unique(np.stack([np.tile(cell, 2), np.concatenate([x, -1 - y])]), axis=1)
        cells.append(both[0])
        at.append(both[1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *cells]), np.concatenate([none, *at])


def _bucket_visits(batches):
    """Rows sorted by (key, lo, hi): (cell, node) rows of every group, groups kept whole over batches."""
    def groups():
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            if not t.num_rows:
                continue
            g = np.stack([t[c].to_numpy() for c in ("key", "lo", "hi")])
            cut = np.concatenate([[0], np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1])
            if cut[-1]:
                yield t.slice(0, cut[-1]), cut
            held = t.slice(cut[-1])
        if held is not None and held.num_rows:
            yield held, np.array([0, held.num_rows])
    for t, cut in groups():
        sig = _signatures(t["sig"].combine_chunks())
        node, comp, cell, load, blk = (t[c].to_numpy() for c in ("node", "comp", "cell", "load", "blk"))
        lo, hi, which = (t[c].to_numpy() for c in ("lo", "hi", "which"))
        cells, nodes = [], []
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s < 2:
                continue
            a = np.arange(s, e)[blk[s:e] == lo[s]]
            b = a if lo[s] == hi[s] else np.arange(s, e)[blk[s:e] == hi[s]]
            c, at = _visits(sig[a], sig[b], node[a], node[b], comp[a], comp[b], cell[a], cell[b], load[a], load[b],
                            which[s], lo[s] == hi[s])
            cells.append(c)
            nodes += [np.where(at >= 0, node[a[np.maximum(at, 0)]], node[b[np.maximum(-1 - at, 0)]])] if len(at) else [at]
        if cells:
            both = np.unique(np.stack([np.concatenate(cells), np.concatenate(nodes)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["cell", "node"])


def _cell_links(share: int):
    """Links that join components among the members of a cell, or of two blocks of it.
    Intersections are counted over the cell's shingle index; members of the largest
    component need not be tried, every other component's members are tried with all."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, comp, blk = (t[c].to_numpy() for c in ("node", "comp", "blk"))
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        shingle, holder = flat[order], of[order]
        begin, end = np.searchsorted(shingle, flat, "left"), np.searchsorted(shingle, flat, "right")
        first = np.concatenate([[0], np.cumsum(size)])
        root = {c: c for c in set(comp.tolist())}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        kinds, count = np.unique(comp, return_counts=True)
        largest = kinds[count.argmax()] if len(kinds) else None
        u, v = [], []
        for i in np.flatnonzero(comp != largest):
            a, b = begin[first[i]:first[i + 1]], end[first[i]:first[i + 1]]
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holder[at], minlength=len(sets))
            hit = np.flatnonzero(100 * common >= share * (size[i] + size - common))
            for j in hit:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[x] = y
                    u.append(int(node[i])), v.append(int(node[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return run


def rows_by_bytes():
    """Size of a group of sets, in rows: their number, or their bytes over ``SET_BYTES`` if more."""
    return F.greatest(F.count("*"), F.ceil(F.sum("bytes") / SET_BYTES))


def with_group_rows(df: DataFrame, key: str, name: str, rows=None, salts: int = 64) -> DataFrame:
    """``df`` with the number of rows of its ``key`` (or the aggregate ``rows``). Counts are
    repeated under ``salts`` salts and rows carry one by their node, so a frequent key's rows
    join in many tasks."""
    count = df.groupBy(key).agg((F.count("*") if rows is None else rows).alias(name)).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(count, [key, "salt"]).drop("salt")


def in_blocks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows (key, node, n rows of the key): every pair of a key's blocks of about ``rows``
    rows, with each row once per block pair it belongs to (columns lo, hi, blk)."""
    blocks = F.ceil(F.col("n") / rows).cast("int")
    df = df.withColumn("blk", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other", "n")


def _linked(share: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        have = {n: np.frombuffer(s, np.uint64) for n, s in zip(sets["node"].to_pylist(), sets["set"].to_pylist())}
        root: dict[int, int] = {}

        def find(n):
            while root.get(n, n) != n:
                root[n] = root.get(root[n], root[n])
                n = root[n]
            return n
        u, v = [], []
        for x, y in zip(pairs["x"].to_pylist(), pairs["y"].to_pylist()):
            rx, ry = find(x), find(y)
            if rx == ry:
                continue                          # already joined by confirmed links
            a, b = have[x], have[y]
            if min(len(a), len(b)) * 100 < share * max(len(a), len(b)):
                continue
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = int((b[at] == a).sum())
            if 100 * common >= share * (len(a) + len(b) - common):
                u.append(x), v.append(y)
                root[rx] = ry
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return run


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (u, v) among pairs (cell, x, y, bytes of y's set): those a spanning forest of each
    part needs. A cell's y are dealt to parts of about 4 * CELL pairs, fewer where sets are
    large; an x goes to every part it has a pair in."""
    size = pairs.groupBy("cell").agg(rows_by_bytes().alias("n_pairs"))
    p = pairs.join(size, "cell").withColumn(
        "part", F.pmod(F.xxhash64("y"), F.ceil(F.col("n_pairs") / (CELL * 4)))).drop("n_pairs", "bytes")
    p = staged(p)
    need = (p.select("cell", "part", F.col("x").alias("node")).unionByName(p.select("cell", "part", F.col("y").alias("node")))
            .distinct().join(sets, "node").select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), "node", "set"))
    return p.groupBy("cell", "part").cogroup(need.groupBy("cell2", "part2")).applyInArrow(_linked(share), "u long, v long")


def _set_table(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, set) of the given classes, read from the text of each class's smallest id. A
    bit table of fixed size drops other documents before the join."""
    slot = F.pmod(F.xxhash64(F.lit(61), F.col("id")), F.lit(FILTER_BITS))
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(nodes, slot, FILTER_BITS))

    def sets(batches):
        for batch in text_slices(batches, "text"):
            s = batch.column("slot").to_numpy()
            asked = (bits.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) > 0
            batch = batch.filter(pa.array(asked))
            if not batch.num_rows:
                continue
            value, first = shingle_sets(batch.column("text"), size)
            s1, s2 = _digests(value, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                ["id2", "t1", "t2", "set"])
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    got = d.withColumn("slot", slot).mapInArrow(sets, "id2 long, t1 long, t2 long, set binary")
    return (nodes.join(got, (F.col("id") == F.col("id2")) & (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")))
            .select("node", "set").dropDuplicates(["node"]))


_NULL_ID = (1 << 63) - 1


def resolve(docs: DataFrame, id_col: str, text_col: str, size: int, share: int) -> DataFrame:
    """Feature rows with (comp_id, comp_key), the smallest (id, text hash) of the row's component."""
    importable(docs.sparkSession)
    feats = features(docs, id_col, text_col, size).withColumn("id", F.coalesce("id", F.lit(_NULL_ID)))
    classes = staged(feats.filter("n_shingles > 0").groupBy("s1", "s2")
                     .agg(F.min(F.struct("id", "key")).alias("least"), F.min("sig").alias("sig"),
                          (F.max("n_shingles") * 8).alias("bytes"))
                     .select("s1", "s2", F.col("least.id").alias("id"), F.col("least.key").alias("key"), "sig", "bytes")
                     .withColumn("node", F.monotonically_increasing_id()))
    sigs = classes.select("node", "sig")
    keys = sigs.mapInArrow(_keys, "key long, which int, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = staged(keys.join(shared, "key"))
    rank = member.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = member.join(rank, "node")
    pivot = ranked.groupBy("key").agg(F.max(F.struct(F.col("degree"), (-F.col("node")).alias("m"))).alias("p"))
    star = (member.join(pivot.select("key", (-F.col("p.m")).alias("y")), "key").select(F.col("node").alias("x"), "y")
            .filter("x <> y").distinct())
    far = signature_distance(F.col("sx"), F.col("sy"))
    star = (star.join(classes.select(F.col("node").alias("x"), F.col("sig").alias("sx"), "bytes"), "x")
            .join(sigs.select(F.col("node").alias("y"), F.col("sig").alias("sy")), "y")
            .select("x", "y", far.alias("far"), "bytes").filter(F.col("far") <= MAX_ERRORS))
    star = staged(star.groupBy("x").agg(F.min(F.struct("far", "y", "bytes")).alias("b"))
                  .select("x", F.col("b.y").alias("y"), F.col("b.bytes").alias("bytes")))
    ids = classes.select("node", "id", "s1", "s2")

    def sets_of(pairs):
        nodes = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        return staged(_set_table(docs, staged(nodes.join(ids, "node")), id_col, text_col, size))
    links = staged(confirm(star.select(F.col("y").alias("cell"), F.col("y").alias("x"), F.col("x").alias("y"), "bytes"),
                           sets_of(star), share))
    comp = staged(connected_components(links))

    # buckets that still span components
    m = member.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = m.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b")
    m = m.drop("n").join(open_keys.select("key", "n"), "key")
    # a lone class belongs to the cell of the component its closest centre is in
    hub = star.select(F.col("x").alias("node"), F.col("y").alias("hub")).join(
        comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub", "left").select(
        "node", F.coalesce("hub_comp", "hub").alias("hub_comp"))
    m = m.join(hub, "node", "left").join(comp.select("node", F.lit(True).alias("joined")), "node", "left")
    m = m.withColumn("cell", F.when(F.col("joined"), F.col("comp")).otherwise(F.coalesce("hub_comp", "comp")))
    m = with_group_rows(m, "cell", "load")
    m = in_blocks(m, "key", CELL).join(sigs, "node").select("key", "lo", "hi", "blk", "which", "node", "comp", "cell", "load", "sig")
    m = m.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    members = staged(m.mapInArrow(_bucket_visits, "cell long, node long").distinct())
    sets = staged(_set_table(docs, staged(members.select("node").distinct().join(ids, "node")), id_col, text_col, size))
    sized = members.join(classes.select("node", "bytes"), "node")
    cells = (in_blocks(with_group_rows(sized, "cell", "n", rows_by_bytes()).drop("bytes"), "cell", CELL // 2)
             .join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(sets, "node"))
    links2 = cells.groupBy("cell", "lo", "hi").applyInArrow(_cell_links(share), "u long, v long")
    final = connected_components(links.unionByName(links2))
    labelled = staged(classes.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = labelled.groupBy("comp").agg(F.min(F.struct("id", "key")).alias("least"))
    first = labelled.select("s1", "s2", "comp").join(least, "comp").select(
        "s1", "s2", F.col("least.id").alias("comp_id"), F.col("least.key").alias("comp_key"))
    linked = F.col("n_shingles") > 0
    return (feats.join(first, ["s1", "s2"], "left")
            .withColumn("comp_id", F.when(linked, F.col("comp_id")).otherwise(F.col("id")))
            .withColumn("comp_key", F.when(linked, F.col("comp_key")).otherwise(F.col("key"))))


_SURVIVES = "id = comp_id and key = comp_key"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id; repeated ids, and null ids
    among themselves, are all kept or all not) for every row. ``share``: least similarity in
    percent; ``size``: words per shingle."""
    r = resolve(docs, id_col, text_col, size, share)

    def known(c):
        return F.when(F.col(c) != _NULL_ID, F.col(c))
    return r.select(known("id").alias("doc_id"), "n_shingles", known("comp_id").alias("component_id"),
                    F.expr("id = comp_id").alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                         share: int = 80) -> DataFrame:
    """The documents with one left of each component, all columns kept: the one with the
    smallest id, with equal (or only null) smallest ids the one of the smallest text hash.
    Of rows that repeat both id and text one stays."""
    r = staged(resolve(docs, id_col, text_col, size, share).select("id", "key", "n_shingles", "comp_id", "comp_key"))
    gone_id, gone_key, again_id, again_key, same_id, same_key = free_names(
        docs, "_gone", "_gone_key", "_again", "_again_key", "_same_id", "_same_key")
    gone = r.filter(f"not ({_SURVIVES})").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    row_id, row_key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), F.xxhash64(F.col(text_col))
    left = docs.join(gone, (row_id == F.col(gone_id)) & (row_key == F.col(gone_key)), "left_anti")
    again = staged(r.filter(f"n_shingles > 0 and {_SURVIVES}").groupBy("id", "key").agg(F.count("*").alias("n"))
                   .filter("n > 1").select(F.col("id").alias(again_id), F.col("key").alias(again_key)))
    if again.isEmpty():
        return left
    same = (row_id == F.col(again_id)) & (row_key == F.col(again_key))
    one = (left.join(again, same, "left_semi").withColumn(same_id, row_id).withColumn(same_key, row_key)
           .dropDuplicates([same_id, same_key]).drop(same_id, same_key))
    return left.join(again, same, "left_anti").unionByName(one)
