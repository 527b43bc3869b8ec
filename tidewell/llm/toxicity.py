"""Toxicity: subsequence string-kernel SVM with Nystroem landmarks.

Instances are words as a reader sees them: letters and digits folded to 31 symbols, other
marks dropped ("i.d-i*ot" is "idiot"), symbols repeated more than twice cut to two, and runs of single-letter words joined ("i d i o t").
The kernel of two instances counts common subsequences of four symbols, each weighted
``DECAY`` per position it spans, with at most two inserted symbols, so gaps and inserted
characters lower the value instead of losing the match. It is divided by the norm that an
instance of its length has when all its subsequences differ, which keeps it a valid kernel.

Training (labels.toxic of documents, bounded sample, documented below): documents are cut
into sentences that take their document's label. Within toxic sentences the instances that
carry the label are unknown; those containing subsequences significantly tied to toxic
documents are the witnesses (positives), instances of clean sentences are the negatives;
evidence is counted in distinct contexts (neighbouring words), so copies count once.
The Nystroem map on the landmarks (frequent witnesses and frequent clean words) feeds a
linear SVM (squared hinge, Newton). Because the kernel is an explicit sum over
subsequences, the trained function is one weight per subsequence: a table of 2**20 floats,
which is what the tasks get. A text's decision value is its largest instance value, turned
into a score by a logistic link fitted on the sampled documents. Whole texts are scored.

Bounds: at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean labelled documents (in
expectation, chosen by hash of doc_id) train the model; at most ``MAX_INSTANCES`` instances
of each class reach the driver; the model is 4 MB.

Defined cases: null and empty texts, and texts without an instance of four symbols, get the
score of "nothing found"; without toxic training labels all scores are 0; repeated label
rows count once, and a document with both labels counts as toxic; null labels and null
doc_ids do not train; repeated rows are each scored; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import arrow_words as A
from tidewell.llm.common import importable, text_slices

THRESHOLD = 0.3
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 9000
MAX_INSTANCES = 20_000
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 128, 128
DECAY = 0.6
REACH = 5                       # positions after the first that a subsequence may span
CODES = 1 << 20                 # 32 symbols ** 4
PURE = 100                      # share of toxic contexts over share of clean ones
NEAR_MISS = 20.0                # weight of clean words that hold a tied subsequence
SIGNIFICANT = 20.0              # likelihood ratio (G2) of a subsequence against the label
MAX_SYMBOLS = 40                # longer instances are scored but do not train
START, END = 31, 0              # symbols before and after each instance

_OFFSETS = [(p, q, r) for p, q, r in combinations(range(1, REACH + 1), 3)]
_SYMBOL = np.zeros(256, dtype=np.int8)           # 0: white space, -1: dropped
_SYMBOL[:] = -1
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28 + np.arange(128) % 3


@dataclass
class Instances:
    """Symbols of all instances of a batch (from START to END)."""
    sym: np.ndarray      # uint32 symbols
    first: np.ndarray    # start of each instance in sym, plus the end
    unit: np.ndarray     # text (or sentence) of each instance


def instances(buf: np.ndarray, offs: np.ndarray) -> Instances:
    s = _SYMBOL[buf]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    keep = s >= 0
    s, row = s[keep], row[keep]
    if len(s) > 2:                                               # a symbol stands at most twice in a row
        long = np.zeros(len(s), bool)
        long[2:] = (s[2:] == s[1:-1]) & (s[1:-1] == s[:-2]) & (row[2:] == row[:-2])
        s, row = s[~long], row[~long]
    if not len(s):
        return Instances(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    letter = s > 0
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(begin)
    word = np.cumsum(begin) - 1                                  # word of each letter
    size = np.bincount(word[letter], minlength=len(start))
    unit = row[start]
    join = np.zeros(len(start), bool)                            # single letters continue their run
    join[1:] = (size[1:] == 1) & (size[:-1] == 1) & (unit[1:] == unit[:-1])
    inst = np.cumsum(~join) - 1
    sym, of = s[letter], inst[word[letter]]
    first = np.searchsorted(of, np.arange(inst[-1] + 2 if len(inst) else 1))
    n = len(first) - 1
    out = np.full(len(sym) + 2 * n, END, dtype=np.uint32)
    out[np.arange(len(sym)) + 2 * of + 1] = sym
    first = first + 2 * np.arange(n + 1)
    out[first[:-1]] = START
    return Instances(out, first, unit[~join])


def _norms(longest: int) -> np.ndarray:
    size = np.arange(longest + 1)
    total = np.zeros(longest + 1)
    for _, _, r in _OFFSETS:
        total += np.maximum(0, size - r) * DECAY ** (2 * (r + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def subsequences(x: Instances) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(positions, codes, weight) for every offset pattern."""
    left = np.repeat(x.first[1:], np.diff(x.first)) - np.arange(len(x.sym))
    for p, q, r in _OFFSETS:
        at = np.flatnonzero(left > r)
        s = x.sym
        yield at, (s[at] << 15) | (s[at + p] << 10) | (s[at + q] << 5) | s[at + r], DECAY ** (r + 1)


def instance_values(x: Instances, weights: np.ndarray, bias: float) -> np.ndarray:
    acc = np.zeros(len(x.sym) + 1, dtype=np.float64)
    for at, code, w in subsequences(x):
        acc[at] += w * weights[code]
    total = np.concatenate([[0.0], np.cumsum(acc)])
    size = np.diff(x.first)
    return (total[x.first[1:]] - total[x.first[:-1]]) / _norms(int(size.max()) if len(size) else 0)[size] + bias


@dataclass
class Model:
    weights: np.ndarray | None     # per subsequence code, or None if nothing was learned
    bias: float = -1.0
    slope: float = 1.0
    shift: float = 0.0

    def decision(self, texts: pa.Array) -> np.ndarray:
        buf, offs = A.text_bytes(texts)
        out = np.full(len(offs) - 1, self.bias)
        x = instances(buf, offs)
        if self.weights is not None and len(x.unit):
            np.maximum.at(out, x.unit, instance_values(x, self.weights, self.bias))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.decision(texts) + self.shift, -50, 50)))


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sentence offsets and the row of each sentence (cut after . ! ? and new lines)."""
    buf, offs = A.text_bytes(texts)
    # a mark ends a sentence only before white space, so that "i.d.i.o.t" stays together
    end = np.isin(buf, np.frombuffer(b".!?", np.uint8))
    space = A.SPACE[buf]
    end[:-1] &= space[1:]
    end |= buf == 10
    cuts = np.unique(np.concatenate([offs, np.flatnonzero(end) + 1]))
    return buf, cuts, np.searchsorted(offs, cuts[:-1], side="right") - 1


def _contexts(batches):
    """Per batch: each instance with each pair of neighbours it stands between, and the
    classes of the sentences it does so in. Counting contexts instead of documents keeps
    copies of one document from passing for evidence."""
    for batch in text_slices(batches, "text"):
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
        buf, cuts, row = sentences(batch.column("text"))
        x = instances(buf, cuts)
        if not len(x.unit):
            continue
        size, toxic = np.diff(x.first), y[row[x.unit]]
        raw = x.sym.astype(np.uint8).tobytes()
        words = [raw[i:j] for i, j in zip(x.first[:-1].tolist(), x.first[1:].tolist())]
        same = np.append(x.unit[1:] == x.unit[:-1], False)
        seen: dict[tuple, list[int]] = {}
        for i in np.flatnonzero((size > 4) & (size <= MAX_SYMBOLS)).tolist():
            key = (words[i], words[i - 1] if i and same[i - 1] else b"", words[i + 1] if same[i] else b"")
            seen.setdefault(key, [0, 0])[1 - toxic[i]] = 1
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([k[0] for k in seen], pa.binary()), "left": pa.array([k[1] for k in seen], pa.binary()),
            "right": pa.array([k[2] for k in seen], pa.binary()),
            "t": pa.array([v[0] for v in seen.values()], pa.int64()), "c": pa.array([v[1] for v in seen.values()], pa.int64())})


def _codes(batches):
    """Contexts of each contiguous subsequence, summed over the words of a batch."""
    for b in batches:
        x = _pack(b.column("word").to_pylist())
        at, code, _ = next(iter(subsequences(x)))
        pair = np.unique((np.searchsorted(x.first, at, side="right") - 1) * CODES + code.astype(np.int64))
        w, code = pair // CODES, pair % CODES
        t = np.bincount(code, b.column("t").to_numpy()[w], CODES)
        c = np.bincount(code, b.column("c").to_numpy()[w], CODES)
        at = np.flatnonzero(t + c)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(t[at].astype(np.int64)),
                                          pa.array(c[at].astype(np.int64))], ["code", "t", "c"])


def _pack(words: list[bytes]) -> Instances:
    size = np.array([len(w) for w in words], dtype=np.int64)
    return Instances(np.frombuffer(b"".join(words), np.uint8).astype(np.uint32),
                     np.concatenate([[0], np.cumsum(size)]), np.arange(len(words)))


def _features(words: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Dense kernel features of words restricted to the sorted codes ``columns``."""
    x = _pack(words)
    out = np.zeros(len(words) * len(columns), dtype=np.float32)
    for at, code, w in subsequences(x):
        inst = np.searchsorted(x.first, at, side="right") - 1
        col = np.searchsorted(columns, code)
        hit = (col < len(columns)) & (columns[np.minimum(col, len(columns) - 1)] == code)
        np.add.at(out, inst[hit] * len(columns) + col[hit], np.float32(w))
    size = np.diff(x.first)
    return out.reshape(len(words), -1) / _norms(int(size.max()))[size][:, None].astype(np.float32)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps on the active rows; last column is the bias."""
    z1 = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(z1.shape[1])
    reg = ridge * len(z) * np.eye(z1.shape[1])
    reg[-1, -1] = 1e-6 * len(z)
    for _ in range(40):
        act = y * (z1 @ w) < 1
        a = z1[act] * weight[act, None]
        new = np.linalg.solve(a.T @ z1[act] + reg, a.T @ y[act])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def _logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score link, by Newton steps with smoothed targets."""
    pos, neg = (weight * (y > 0)).sum(), (weight * (y <= 0)).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        g = x.T @ (weight * (p - goal)) + np.array([1e-3 * a, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.clip(np.linalg.solve(h, g), -3, 3)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train_rule: Column | None = None) -> Model:
    """Fit on labelled documents; ``train_rule`` (a condition on ``id_col``) limits them."""
    spark = docs.sparkSession
    importable(spark)
    lab = labels.select(F.col(id_col).alias(id_col), F.col(label_col).cast("int").alias("_y")).dropna()
    if train_rule is not None:
        lab = lab.filter(train_rule)
    lab = lab.groupBy(id_col).agg(F.max("_y").alias("_y"))
    per = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).filter("_y in (0, 1)").collect()}
    if not per.get(1) or not per.get(0):
        return Model(None)
    part = F.pmod(F.xxhash64(F.lit(71), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    take = lab.filter(((F.col("_y") == 1) & (part < SAMPLE_TOXIC / per[1]))
                      | ((F.col("_y") == 0) & (part < SAMPLE_CLEAN / per[0])))
    ids = [(r[0], r[1]) for r in take.collect()]             # bounded by the sample sizes
    chosen = spark.createDataFrame(ids, take.schema) if ids else take
    sample = (docs.select(F.col(id_col), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
              .join(F.broadcast(chosen), id_col).select("text", F.col("_y").alias("y")))
    words = (sample.mapInArrow(_contexts, "word binary, left binary, right binary, t long, c long")
             .groupBy("word", "left", "right").agg(F.max("t").alias("t"), F.max("c").alias("c"))
             .groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).persist())
    whole = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n1, n0 = float(whole["t"] or 0), float(whole["c"] or 0)
    if not n1 or not n0:
        return Model(None)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")

    def xlogy(a, b):
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    share = n1 / (n1 + n0)
    g2 = 2 * (xlogy(t, (t + c) * share) + xlogy(c, (t + c) * (1 - share)))
    strong = (F.col("g2") >= SIGNIFICANT) & (t / n1 > 8 * c / n0)
    tied = (words.mapInArrow(_codes, "code long, t long, c long").groupBy("code")
            .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("g2", g2).filter(strong)
            .orderBy(F.desc("g2"), "code").limit(MAX_INSTANCES).collect())
    codes = np.sort(np.array([r["code"] for r in tied], dtype=np.int64))
    pure = np.sort(np.array([r["code"] for r in tied if r["t"] / n1 > PURE * r["c"] / n0], dtype=np.int64))

    def contains(some: list[bytes], wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(some), bool)
        if some and len(wanted):
            x = _pack(some)
            at, code, _ = next(iter(subsequences(x)))
            out[np.searchsorted(x.first, at[np.isin(code, wanted)], side="right") - 1] = True
        return out

    def near_misses(batches):
        for b in batches:
            yield b.filter(pa.array(contains(b.column("word").to_pylist(), codes)))
    # witnesses: words tied to toxic documents themselves, or through a subsequence that
    # clean documents (nearly) never have
    own = (words.withColumn("g2", g2).filter(strong).orderBy(F.desc("g2"), "word").limit(MAX_INSTANCES)
           .select("word", "t").collect())
    toxic = words.filter(t / n1 > 8 * c / n0).orderBy(F.desc("t"), "word").limit(MAX_INSTANCES).select("word", "t").collect()
    through = contains([bytes(r["word"]) for r in toxic], pure)
    pos = {bytes(r["word"]): r["t"] for r in [*own, *[r for r, ok in zip(toxic, through) if ok]]}
    plain = words.filter("c > 0").select("word", "c")
    clean = [*plain.mapInArrow(near_misses, plain.schema).orderBy(F.desc("c"), "word").limit(MAX_INSTANCES // 2).collect(),
             *plain.orderBy(F.desc("c"), "word").limit(MAX_INSTANCES // 4).collect(),
             *plain.orderBy(F.xxhash64("word"), "word").limit(MAX_INSTANCES // 4).collect()]
    words.unpersist()
    if not pos:
        return Model(None)
    neg = {bytes(r["word"]): r["c"] for r in clean if bytes(r["word"]) not in pos}
    if not neg:
        return Model(None)
    common = sorted(neg, key=lambda w: (-neg[w], w))
    marks = sorted(pos, key=lambda w: (-pos[w], w))[:LANDMARKS_TOXIC] + list(dict.fromkeys(
        [*list(neg)[:LANDMARKS_CLEAN // 2], *common[:LANDMARKS_CLEAN // 2]]))
    columns = np.unique(np.concatenate([code for _, code, _ in subsequences(_pack(marks))])).astype(np.int64)
    fm = _features(marks, columns).astype(np.float64)
    value, vector = np.linalg.eigh(fm @ fm.T + 1e-6 * np.eye(len(marks)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T          # K_mm ** -1/2
    rows = list(pos) + list(neg)
    y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
    z = np.concatenate([_features(rows[i:i + 1000], columns) @ fm.T @ root for i in range(0, len(rows), 1000)])
    # rows weigh by the root of their contexts, near misses more; each class weighs the same
    weight = np.sqrt(np.array([*pos.values(), *neg.values()], dtype=np.float64))
    weight *= np.where((y < 0) & contains(rows, codes), NEAR_MISS, 1.0)
    weight *= len(rows) / 2 / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    w = _svm(z, y, weight)
    table = np.zeros(CODES, dtype=np.float32)
    table[columns] = fm.T @ (root @ w[:-1])
    model = Model(table, float(w[-1]))

    def values(batches):
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(model.decision(b.column("text"))), b.column("y")], ["f", "y"])
    got = sample.mapInArrow(values, "f double, y int").collect()    # one row per sampled document
    f, yy = np.array([r["f"] for r in got]), np.array([r["y"] for r in got])
    prior = np.where(yy == 1, per[1] / max(1, (yy == 1).sum()), per[0] / max(1, (yy == 0).sum()))
    model.slope, model.shift = _logistic(f, yy, prior * len(yy) / prior.sum())
    return model


def toxicity_score(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1 (null counts as empty)."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        done = [model.score(p.column(0)) for p in text_slices([batch], "t")]
        return pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())
    return score(F.coalesce(text, F.lit("")))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored below the threshold, all columns kept."""
    return docs.filter(toxicity_score(F.col(text_col), model) < threshold)
