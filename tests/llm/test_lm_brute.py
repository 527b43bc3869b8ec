"""Scores of the context-tree model against a direct recursive tree, and the base columns
against counting, over slice and block borders."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewell.llm import blocks, lm_score
from tidewell.llm.common import importable

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def model_text(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return b"".join(w + b" " for w in words) + b"\n", words


def kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """Every node's counts in a dictionary: (context, nearest byte first; bits so far)."""

    def __init__(self, texts, depth):
        self.depth, self.count, self.longer, self.known = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for t in texts:
            for ctx, prefix, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.count[ctx[:d], prefix][bit] += 1
                    if d < depth:
                        self.longer[ctx[:d], prefix].add(ctx[:d + 1])

    def decisions(self, t):
        for i, byte in enumerate(t):
            ctx = (bytes(self.depth) + t[:i])[-1:-self.depth - 1:-1]
            bits = format(byte, "08b")
            for k in range(8):
                yield ctx, bits[:k], int(bits[k])

    def weighted(self, ctx, prefix):
        key = ctx, prefix
        if key not in self.known:
            own = kt(*self.count[key])
            if len(ctx) < self.depth:
                rest = sum(self.weighted(c, prefix) for c in self.longer[key])
                top = max(own, rest)
                own = math.log(.5) + top + math.log(math.exp(own - top) + math.exp(rest - top))
            self.known[key] = own
        return self.known[key]

    def one(self, ctx, prefix, d=0):
        key = ctx[:d], prefix
        zeros, ones = self.count[key] if key in self.count else (0, 0)
        est = (ones + .5) / (zeros + ones + 1)
        if d == self.depth or (ctx[:d + 1], prefix) not in self.count:
            return est
        stop = math.exp(math.log(.5) + kt(zeros, ones) - self.weighted(*key))
        return stop * est + (1 - stop) * self.one(ctx, prefix, d + 1)

    def log10(self, t):
        total = 0.0
        for ctx, prefix, bit in self.decisions(t):
            p = self.one(ctx, prefix)
            total += math.log10(p if bit else 1 - p)
        return total


def test_scores_and_base_columns(spark, monkeypatch):
    importable(spark)
    rnd = random.Random(9)
    vocab = ["the", "then", "them", "Cat", "catalog", "dog", "é", "x1"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 25))) for _ in range(40)] + [None, "", "the\tthe\n cat"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "dog dog")]
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 150)      # several slices a block, several blocks
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1200)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = lm_score.score(df, F.col("doc_id") % 10 != 0).collect()
    train = [t for i, t in rows if i is None or i % 10 != 0]
    counts = Counter(w for t in train for w in [*model_text(t)[1], None])
    n, v = sum(counts.values()), len(counts)
    tree = Tree([model_text(t)[0] for t in train], lm_score.DEPTH)
    want = []
    for i, t in rows:
        tokens = [*model_text(t)[1], None]
        base = sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in tokens)
        want.append((i if i is not None else -1, i is not None and i % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), n,
                     base, tree.log10(model_text(t)[0])))
    have = [(r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
             r["base_score"], r["score"]) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * abs(b[5]) and abs(a[6] - b[6]) < 1e-5 * abs(b[6])
