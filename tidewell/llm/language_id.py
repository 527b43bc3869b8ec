"""Language ID: nearest of several clustered TF-IDF centroids per language, by cosine.

A text's vector holds its byte bigrams and trigrams (A-Z lower-cased; letters and bytes of
non-ASCII characters kept, everything else a word border), hashed to ``DIMENSIONS``; each
count becomes (1 + log count) * idf and the vector has length 1. The idf counts every
training document. Each language has up to ``CLUSTERS`` centroids from spherical k-means on
a sample of at most ``SAMPLE`` training documents a language in expectation, chosen by hash
of doc_id (a documented bound; whole texts are used). The prediction is the language of the
centroid with the greatest cosine, the score that cosine; texts farther from it than nearly
all training texts of that language (``REJECT_QUANTILE``) are flagged ``rejected``.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing could be learned; null languages and null texts do not train; ties go to
the language first by code point; repeated rows are each predicted; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import arrow_words as A
from tidewell.llm.common import importable, text_slices

DIMENSIONS = 4096
CLUSTERS = 4
SAMPLE = 400
REJECT_QUANTILE = 0.999
ROWS = 512               # texts turned into dense vectors at once

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Dense counts (texts x DIMENSIONS)."""
    buf, offs = A.text_bytes(texts)
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    s = np.full(len(buf) + n + 1, 32, dtype=np.uint32)     # one border before each text and at the end
    s[np.arange(len(buf)) + row + 1] = _FOLD[buf]
    of = np.minimum(np.repeat(np.arange(n + 1), np.append(np.diff(offs) + 1, 1)), max(n - 1, 0))
    a, b, c = s[:-2], s[1:-1], s[2:]
    flat = []
    two = (a != 32) | (b != 32)
    h = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    flat.append(of[:-2][two] * DIMENSIONS + (h >> np.uint32(20))[two])
    three = (b != 32) & two
    h = (a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1) + c * np.uint32(0x9E3779B1) + np.uint32(77)) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    flat.append(of[:-2][three] * DIMENSIONS + ((h * np.uint32(0xC2B2AE3D)) >> np.uint32(20))[three])
    return np.bincount(np.concatenate(flat).astype(np.int64), minlength=n * DIMENSIONS)[:n * DIMENSIONS].reshape(n, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _blocks(texts: pa.Array):
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    for part in text_slices([batch], "t"):
        for i in range(0, part.num_rows, ROWS):
            yield part.column(0).slice(i, ROWS)


@dataclass
class Model:
    languages: list[str]        # language of each centroid
    centroids: np.ndarray       # centroids x DIMENSIONS, unit length
    idf: np.ndarray
    limit: np.ndarray           # least accepted cosine of each centroid's language

    def predict(self, texts: pa.Array):
        best, cos = [], []
        for block in _blocks(texts):
            sims = vectors(gram_counts(block), self.idf) @ self.centroids.T
            k = sims.argmax(axis=1)
            best.append(k)
            cos.append(sims[np.arange(len(k)), k])
        return (np.concatenate(best), np.concatenate(cos)) if best else (np.zeros(0, int), np.zeros(0))


def _frequencies(batches):
    """Documents of this task that contain each dimension (at most DIMENSIONS rows)."""
    df = np.zeros(DIMENSIONS, dtype=np.int64)
    for batch in batches:
        for block in _blocks(batch.column("text")):
            df += (gram_counts(block) > 0).sum(axis=0)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["dim", "df"])


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, farthest-first start from the mean's nearest text."""
    mean = x.mean(axis=0)
    picks = [int((x @ mean).argmax())]
    while len(picks) < min(k, len(x)):
        far = (x @ x[picks].T).max(axis=1)
        if far.min() > 0.9999:
            break
        picks.append(int(far.argmin()))
    c = x[picks]
    for _ in range(15):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_rule: Column | None = None) -> Model | None:
    """Fit on documents with a language; None if there are none. Languages are labels: one
    row per language reaches the driver."""
    importable(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    if train_rule is not None:
        d = docs.filter(train_rule).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"),
                                           F.col(lang_col).alias("lang"))
    d = d.dropna(subset=["text", "lang"])
    per = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    freq = (d.select("text").mapInArrow(_frequencies, "dim long, df long")
            .groupBy("dim").agg(F.sum("df").alias("df")).collect())
    total = sum(per.values())
    idf = np.full(DIMENSIONS, np.log(total + 1.0) + 1, dtype=np.float32)
    for r in freq:
        idf[r["dim"]] = np.log((1 + total) / (1 + r["df"])) + 1
    part = F.pmod(F.xxhash64(F.lit(91), "_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(v) for k, n in sorted(per.items()) for v in (k, min(1.0, SAMPLE / n))])
    sample = d.filter(part < share[F.col("lang")]).select("lang", "text")

    def embed(batches):
        for batch in batches:
            i = 0
            for block in _blocks(batch.column("text")):
                x = vectors(gram_counts(block), idf).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(i, len(x)), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "v"])
                i += len(x)
    by: dict[str, list[np.ndarray]] = {}
    for r in sample.mapInArrow(embed, "lang string, v binary").collect():
        by.setdefault(r["lang"], []).append(np.frombuffer(bytes(r["v"]), np.float32))
    langs, cents, limits = [], [], []
    for lang in sorted(by, key=lambda v: v.encode()):
        x = np.stack(sorted(by[lang], key=lambda v: v.tobytes()))
        c = _kmeans(x, CLUSTERS)
        near = (x @ c.T).max(axis=1)
        langs += [lang] * len(c)
        cents.append(c)
        limits += [float(np.quantile(near, 1 - REJECT_QUANTILE))] * len(c)
    return Model(langs, np.concatenate(cents), idf, np.array(limits)) if cents else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    importable(docs.sparkSession)
    lettered = F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("rejected"))

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(texts: pa.Array) -> pa.Array:
        k, cos = model.predict(texts)
        return pa.StructArray.from_arrays(
            [pa.array([model.languages[i] for i in k], pa.string()), pa.array(np.clip(cos, 0, 1).astype(np.float64)),
             pa.array(cos < model.limit[k] if len(k) else np.zeros(0, bool))], ["lang", "score", "rejected"])
    got = docs.select(F.col(id_col).alias("doc_id"), lettered.alias("_ok"),
                      nearest(F.coalesce(F.col(text_col), F.lit(""))).alias("_p"))
    return got.select("doc_id", F.when(F.col("_ok"), F.col("_p.lang")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("_ok"), F.col("_p.score")).otherwise(0.0).alias("score"),
                      (~F.col("_ok") | F.col("_p.rejected")).alias("rejected"))
