"""Token counts: batch encoding in Arrow functions that return lengths only.

``count_tokens`` gives an Arrow column function. A batch is cut into slices of about
``SLICE_BYTES`` of text, so a task holds one slice at a time however long the texts are.
Inside a slice every text is split at safe boundaries: white space between two pieces, for
tokenizers that drop white space and never join across it (``splits_at_space``), so that
equal pieces are encoded once per slice and long texts never reach the encoder whole. For
other tokenizers long texts are split before a space that follows a letter, where their
pre-tokenizer always starts a new piece, and are otherwise encoded as they are.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text without a safe
boundary (one very long word) is encoded whole; repeated rows each get their row.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import arrow_words as A
from tidewell.llm.common import importable, text_slices

LIMIT = 2048
SLICE_BYTES = 8 << 20
ENCODE_PIECES = 20_000




class Counter:
    """Lengths of texts under a tokenizers ``.json`` file, opened once per Python worker."""

    _open: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_piece = splits_at_space(json.load(f))

    @classmethod
    def at(cls, path: str) -> "Counter":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode_lengths(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts), dtype=np.int64)
        for i in range(0, len(texts), ENCODE_PIECES):
            enc = self.tok.encode_batch_fast(texts[i:i + ENCODE_PIECES], add_special_tokens=False)
            out[i:i + ENCODE_PIECES] = [len(e) for e in enc]
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        if not self.by_piece:
            return self.whole_lengths(texts)
        w = A.find_words(texts)
        if not len(w.start):
            return np.zeros(w.rows, np.int64)
        # equal pieces by 128-bit hash; each is encoded once
        h, h2 = A.word_hash(w, 1), A.word_hash(w, 2)
        order = np.lexsort((h2, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        rep = order[new]
        raw = w.buf.tobytes()
        pieces = [raw[s:e].decode("utf-8") for s, e in zip(w.start[rep].tolist(), w.end[rep].tolist())]
        n = self.encode_lengths(pieces)[group]
        total = np.concatenate([[0], np.cumsum(n)])
        return total[w.first[1:]] - total[w.first[:-1]]

    def whole_lengths(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts.to_pylist()):
            if t:
                out[i] = int(self.encode_lengths(list(safe_parts(t))).sum())
        return out


def splits_at_space(spec: dict) -> bool:
    """True if the tokenizer's rules drop white space before merging, so that the tokens of
    a text are the tokens of its space-separated pieces: normalisers act on characters or
    white-space runs, and the pre-tokenizer keeps only pieces without white space."""
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm]) if norm else []
    safe_norm = all(s.get("type") in ("NFC", "Lowercase") or
                    (s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ")
                    for s in steps)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
             and r"[^\s" in json.dumps(first.get("pattern"), ensure_ascii=False).replace("\\\\", "\\"))
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"]
                for t in spec.get("added_tokens", []))
    return safe_norm and drops and added and not spec.get("post_processor")


def safe_parts(text: str, size: int = 1 << 20):
    """Parts of a long text, cut before a single ASCII space between two ASCII letters."""
    begin = 0
    while len(text) - begin > size:
        cut = begin + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha()
                                           and text[cut + 1].isascii() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of a text column (long; null: 0) under the tokenizers file at ``path``, which
    every executor must be able to open."""
    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        counter, done = Counter.at(path), []
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        for part in text_slices([batch], "t", SLICE_BYTES):
            done.append(counter.lengths(part.column(0)))
        return pa.array(np.concatenate(done) if done else np.zeros(0, np.int64), pa.int64())

    return lengths(F.coalesce(text, F.lit("")))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    importable(df.sparkSession)
    out = df.select(F.col(id_col).alias("doc_id"),
                    F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
                    count_tokens(F.col(text_col), path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
