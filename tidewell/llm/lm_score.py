"""LM scoring by context-tree weighting over bytes.

Text as the model sees it: words (A-Z lower-cased, white space dropped), each followed by a
space, and a new line at the end of the text, so byte strings and token sequences are one to
one. Every byte is eight binary decisions, first bit first. For a decision with the bits
before it in the byte, the contexts are the last 0 to ``DEPTH`` bytes (bytes before the text
count as zero). Each node, a context with a bit prefix, keeps Krichevsky-Trofimov counts of
the training texts; its weighted probability is half its own KT block probability plus half
the product over its longer contexts, and a prediction mixes the KT estimates of all depths
with the resulting posterior weights. A context that training never saw passes its share to
the longest one it saw.

Spark part: texts are packed in blocks once. Each block sends its distinct (context, byte)
grams with their training counts, one row per (bucket, block), where a bucket holds all
grams whose last two context bytes it owns (contexts that a sample finds to hold more grams
than a bucket should are dealt by three or more bytes instead); nothing is pruned, so the counts gathered grow
with the corpus. A bucket is merged once and written as one row: its distinct grams with
their counts, and each block's places among them (small differences instead of keys). The
same pass sums the weighted probabilities up to depth 1, a table of at most 2**16 rows that
finishes depths 1 and 0 on the driver, and at most 511 rows of each split context, finished
there before (one per million grams at most, and depth); a second pass reads the merged buckets, without
another exchange, and returns each block the code length of its grams. Word counts for the
base score travel in one exchange and back. Inside a block, texts are worked on in slices of
about 512 KB. A text longer than a block is a block of its own.

Defined cases: null and empty texts are one end token; without training texts the base
score takes V = N = 0 and every byte costs eight bits; repeated rows count and are scored
each; null ids train unless the rule says otherwise; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import arrow_words as A
from tidewell.llm import blocks as B

DEPTH = 6                 # context bytes; a gram is DEPTH + 1 bytes of a 64-bit key
SPACE, END = 32, 10
_END_WORD = A.constants(1, 401)      # stands for the end token among word hashes
WORDS_A_BYTE = 0.05       # distinct words of a block per byte of text
GRAM_KEYS = 1 << 19       # grams of a bucket before it is merged, about
SPLIT_KEYS = B.KEYS_PER_BUCKET       # a context with more grams is dealt by one more byte
SLICE_BYTES = 1 << 19     # of a block's text worked on at once
SAMPLE_BYTES = 1 << 20    # of a block, to find such contexts
_HALF = math.log(0.5)
_SMALL = np.array([math.lgamma(i + 0.5) for i in range(1024)])
_SMALL1 = np.array([math.lgamma(i + 1.0) for i in range(2048)])


def _lgamma(x: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(x + shift) of whole x: a table, and Stirling's series beyond it."""
    out = table[np.minimum(x, len(table) - 1)]
    big = x >= len(table)
    if big.any():
        z = x[big] + shift
        out = out.copy()
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3)
    return out


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a block with a zeros and b ones."""
    return _lgamma(a, _SMALL, 0.5) + _lgamma(b, _SMALL, 0.5) - _lgamma(a + b, _SMALL1, 1.0) - math.log(math.pi)


class Depth:
    """Counts at one depth: ctx (context as a number) and sym, sorted, with counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n                       # key = ctx * 256 + sym

    def level(self, bit: int):
        """Nodes of a bit level: (node of each entry, zeros, ones, node's ctx * 256 + prefix)."""
        node = self.key >> np.uint64(8 - bit)           # ctx followed by the first bits
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        at = np.cumsum(new) - 1
        one = ((self.key >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        size = at[-1] + 1 if len(at) else 0
        ones = np.bincount(at, np.where(one, self.n, 0), size).astype(np.int64)
        zeros = np.bincount(at, np.where(one, 0, self.n), size).astype(np.int64)
        return at, zeros, ones, node[new], one


def shorten(d: Depth, drop_shift: int) -> tuple[Depth, np.ndarray]:
    """The depth above: oldest context byte cut off; and each entry's place there."""
    sym = d.key & np.uint64(255)
    key = ((d.key >> np.uint64(8 + drop_shift)) << np.uint64(8)) | sym
    up, at = np.unique(key, return_inverse=True)
    return Depth(up, np.bincount(at, d.n, len(up)).astype(np.int64)), at


def _tree(key: np.ndarray, n: np.ndarray, depth: int, stop: int):
    """Depths ``depth`` down to ``stop`` (lists from deep to shallow) and the places of each
    depth's entries in the next."""
    deep, places = [Depth(key, n)], []
    for _ in range(depth - stop):
        up, at = shorten(deep[-1], 8)
        deep.append(up)
        places.append(at)
    return deep, places


def _weighted(deep: list[Depth], places, bit: int, below: np.ndarray | None = None):
    """Per depth (deep to shallow): node of each entry, KT of a one, log weight of stopping,
    seen, weighted log probability. ``below``: weighted sums of longer contexts for the
    first depth, where that depth is not the deepest of the tree."""
    out, sums = [], below
    for k, d in enumerate(deep):
        at, zeros, ones, node, one = d.level(bit)
        own = kt_block(zeros, ones)
        if sums is None:
            whole, stop = own, np.zeros(len(own))
        else:
            whole = np.logaddexp(_HALF + own, _HALF + sums)
            stop = _HALF + own - whole
        out.append((at, (ones + 0.5) / (zeros + ones + 1.0), stop, (zeros + ones) > 0, whole, node, one))
        if k < len(places):
            # first entry of each node leads to its node above
            lead = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
            up_at = deep[k + 1].level(bit)[0]
            sums = np.bincount(up_at[places[k][lead]], whole, up_at.max() + 1 if len(up_at) else 0)
    return out


def _log_probability(deep, places, above, depth_stop: int) -> np.ndarray:
    """log2 probability of each gram's byte. ``above`` gives, for a bit and the entries of
    the shallowest depth, the already mixed (weights, estimates) of depths below ``stop``."""
    total = np.zeros(len(deep[0].key))
    for bit in range(8):
        levels = _weighted(deep, places, bit)
        place = [np.arange(len(deep[0].key))]
        for at in places:
            place.append(at[place[-1]])
        one = levels[0][6]
        p, known = None, None
        for (at, kt, stop, seen, *_), pos in zip(levels, place):
            node = at[pos]
            est, ok, w = kt[node], seen[node], np.exp(np.minimum(stop[node], 0.0))
            if p is None:
                p, known = est, ok
            else:
                p = np.where(known, w * est + (1 - w) * p, est)
                known = known | ok
        p = above(bit, deep[0].key, p, known)
        total += np.log2(np.where(one, p, 1 - p))
    return total


class Top:
    """Depths 1 and 0, finished on the driver from sums over the buckets."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray):
        """counts[ctx, sym]; sums[bit, ctx * 256 + prefix]: weighted log probabilities of depth 2."""
        key = np.flatnonzero(counts.ravel()).astype(np.uint64)
        one = Depth(key, counts.ravel()[key.astype(np.int64)])
        deep, places = _tree_from(one)
        self.kt = np.full((2, 8, 1 << 16), 0.5)
        self.stop = np.zeros((2, 8, 1 << 16))
        self.seen = np.zeros((2, 8, 1 << 16), bool)
        for bit in range(8):
            node = one.level(bit)[3]
            slot = ((node >> np.uint64(bit)) * np.uint64(256) + (node & np.uint64((1 << bit) - 1))).astype(np.int64)
            for k, (_, kt, stop, seen, _, nd, _) in enumerate(_weighted(deep, places, bit, sums[bit][slot])):
                s = ((nd >> np.uint64(bit)) * np.uint64(256) + (nd & np.uint64((1 << bit) - 1))).astype(np.int64)
                self.kt[k, bit, s], self.stop[k, bit, s], self.seen[k, bit, s] = kt, stop, seen

    def __call__(self, bit: int, key: np.ndarray, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        sym = (key & np.uint64(255)).astype(np.int64)
        last = (key >> np.uint64(8 * DEPTH)).astype(np.int64) & 255
        prefix = sym >> (8 - bit)
        for k, s in ((0, last * 256 + prefix), (1, prefix)):
            w = np.exp(np.minimum(self.stop[k, bit, s], 0.0))
            p = np.where(known, w * self.kt[k, bit, s] + (1 - w) * p, self.kt[k, bit, s])
            known = known | self.seen[k, bit, s]
        return p


def _tree_from(one: Depth):
    up, at = shorten(one, 8)
    return [one, up], [at]


def grams(texts: pa.Array):
    """(gram key of every byte of the model's text, text of each byte, words). The key has the
    nearest context byte in its highest place, then older ones, then the byte itself."""
    w = A.find_words(texts, lower=True)
    n = len(w.start)
    size = w.end - w.start + 1
    per = np.bincount(w.row, size, w.rows).astype(np.int64) + 1             # with the end byte
    begin = np.concatenate([[0], np.cumsum(per)])
    out = np.full(begin[-1], SPACE, dtype=np.uint8)
    place = np.cumsum(size) - size + w.row                                    # start of each word in out
    text = np.ones(len(out), bool)                                            # bytes of words, in order
    text[place + size - 1] = False
    text[begin[1:] - 1] = False
    out[text] = w.buf[~A.SPACE[w.buf]]
    out[begin[1:] - 1] = END
    key = out.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        older = np.zeros(len(out), dtype=np.uint64)
        older[d:] = out[:-d] if d <= len(out) else 0
        # no byte before the text; beyond a text shorter than d lies the next one's beginning
        early = (begin[:-1, None] + np.arange(d)).ravel()
        older[early[early < len(out)]] = 0
        key |= older << np.uint64(8 * (DEPTH + 1 - d))
    return key, begin, w


class Split:
    """Which contexts are dealt by more than their last two bytes. ``hot[d]``: contexts of d
    bytes (sorted) with more grams than a bucket should hold; their grams are dealt by d + 1
    bytes, or more where that is hot too. Sampled, so it only decides where a gram is counted."""

    def __init__(self, hot: dict[int, np.ndarray]):
        self.hot, self.mixed = {1: np.arange(256, dtype=np.uint64)}, {}
        for d in range(2, DEPTH):
            found = np.unique(np.asarray(hot.get(d, ()), np.uint64))
            self.hot[d] = found[np.isin(found >> np.uint64(8), self.hot[d - 1])] if d > 2 else found

    def leaf(self, key: np.ndarray) -> np.ndarray:
        """Context bytes by which each gram is dealt."""
        out = np.full(len(key), 2)
        at = np.arange(len(key))
        for d in range(2, DEPTH):
            if not len(self.hot[d]):
                break
            at = at[np.isin(key[at] >> np.uint64(8 * (DEPTH + 1 - d)), self.hot[d])]
            out[at] = d + 1
        return out

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Hash of the context bytes a gram is dealt by."""
        return A.mix(key >> (8 * (DEPTH + 1 - self.leaf(key))).astype(np.uint64)) >> np.uint64(20)

    def parts(self, key: np.ndarray):
        """(context bytes dealt by, places of these grams)."""
        leaf = self.leaf(key)
        return [(int(d), np.flatnonzero(leaf == d)) for d in np.unique(leaf)]

    def sums(self, key: np.ndarray, n: np.ndarray):
        """(kind, slot, value) of a bucket's trained grams for the depth above the one they are
        dealt by: kind = 16 * depth + bit for weighted log probabilities, + 15 for counts."""
        out = []
        for depth, at in self.parts(key):
            deep, places = _tree(key[at], n[at], DEPTH, depth)
            size = 256 * len(self.hot[depth - 1])
            sym = (deep[-1].key & np.uint64(255)).astype(np.int64)
            per = [(15, np.bincount(self._slot(deep[-1].key >> np.uint64(16), depth - 1) + sym, deep[-1].n, size))]
            for bit in range(8):
                *_, (_, _, _, _, whole, node, _) = _weighted(deep, places, bit)
                prefix = (node & np.uint64((1 << bit) - 1)).astype(np.int64)
                per.append((bit, np.bincount(self._slot(node >> np.uint64(bit + 8), depth - 1) + prefix, whole, size)))
            for k, value in per:
                slot = np.flatnonzero(value)
                out.append((np.full(len(slot), 16 * depth + k), slot, value[slot].astype(np.float64)))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]

    def _slot(self, ctx: np.ndarray, depth: int) -> np.ndarray:
        return np.searchsorted(self.hot[depth], ctx) * 256

    def finish(self, rows) -> None:
        """Finish hot contexts, longest first, then depths 1 and 0, from the summed rows."""
        counts = {d: np.zeros(256 * len(self.hot[d - 1]), np.int64) for d in range(2, DEPTH + 1)}
        sums = {d: np.zeros((8, 256 * len(self.hot[d - 1]))) for d in range(2, DEPTH + 1)}
        for kind, slot, value in rows:
            depth, k = divmod(kind, 16)
            if k == 15:
                counts[depth][slot] = int(value)
            else:
                sums[depth][k, slot] = value
        for d in range(DEPTH - 1, 1, -1):
            if not len(self.hot[d]):
                continue
            at = np.flatnonzero(counts[d + 1])
            one = Depth((self.hot[d][at >> 8] << np.uint64(8)) | (at & 255).astype(np.uint64), counts[d + 1][at])
            np.add.at(counts[d], self._slot(one.key >> np.uint64(16), d - 1) + (at & 255), one.n)
            kt, stop, seen = np.full(255 * len(self.hot[d]), 0.5), np.zeros(255 * len(self.hot[d])), np.zeros(255 * len(self.hot[d]), bool)
            for bit in range(8):
                node = one.level(bit)[3]
                prefix = (node & np.uint64((1 << bit) - 1)).astype(np.int64)
                slot = self._slot(node >> np.uint64(bit), d)
                (_, est, log_stop, some, whole, _, _), = _weighted([one], [], bit, sums[d + 1][bit][slot + prefix])
                to = slot // 256 * 255 + (1 << bit) - 1 + prefix
                kt[to], stop[to], seen[to] = est, log_stop, some
                np.add.at(sums[d][bit], self._slot(node >> np.uint64(bit + 8), d - 1) + prefix, whole)
            self.mixed[d] = kt, stop, seen
        self.top = Top(counts[2].reshape(256, 256), sums[2])

    def code_lengths(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(key))
        for depth, at in self.parts(key):
            deep, places = _tree(key[at], n[at], DEPTH, depth)
            bits[at] = -_log_probability(deep, places, lambda *a, depth=depth: self._above(depth, *a), depth)
        return bits

    def _above(self, depth: int, bit: int, key: np.ndarray, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        prefix = (key & np.uint64(255)).astype(np.int64) >> (8 - bit)
        for d in range(depth - 1, 1, -1):
            kt, stop, seen = self.mixed[d]
            at = self._slot(key >> np.uint64(8 * (DEPTH + 1 - d)), d) // 256 * 255 + (1 << bit) - 1 + prefix
            w = np.exp(np.minimum(stop[at], 0.0))
            p = np.where(known, w * kt[at] + (1 - w) * p, kt[at])
            known = known | seen[at]
        return self.top(bit, key, p, known)


def _sample_blocks(packed: DataFrame, blocks: int) -> DataFrame:
    return packed.filter(F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks // 16)))) == 0).select("data")


def _sampled(data: bytes) -> tuple[int, np.ndarray]:
    """Bytes and distinct grams of about 1 MB of a block's texts."""
    texts = Block(data).texts
    size = max(1, len(A.text_bytes(texts)[0]))
    texts = texts.take(pa.array(np.arange(0, len(texts), -(-size // SAMPLE_BYTES))))
    return max(1, len(A.text_bytes(texts)[0])), np.unique(grams(texts)[0])


def grams_a_byte(packed: DataFrame, blocks: int) -> float:
    """Distinct grams of a block per byte of its text, measured on about 1 MB of up to about 16
    blocks (a whole block repeats more, so this is rather too much)."""
    def sample(batches):
        for batch in batches:
            for blob in batch.column("data"):
                size, key = _sampled(blob.as_py())
                yield pa.RecordBatch.from_pydict({"size": [size], "n": [len(key)]})
    r = _sample_blocks(packed, blocks).mapInArrow(sample, "size long, n long").agg(F.sum("n"), F.sum("size")).first()
    return r[0] / r[1] if r[1] else 0.1


def hot_contexts(packed: DataFrame, blocks: int, total: int, limit: int) -> dict[int, np.ndarray]:
    """Contexts of 2 to DEPTH - 1 bytes with more than about ``limit`` grams summed over the
    blocks, read from about 1 MB of up to about 16 blocks."""
    def sample(batches):
        for batch in batches:
            for blob in batch.column("data"):
                size, key = _sampled(blob.as_py())
                rows = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([size]))]
                for d in range(2, DEPTH):
                    ctx, n = np.unique(key >> np.uint64(8 * (DEPTH + 1 - d)), return_counts=True)
                    many = n * (total / size) > limit / 4
                    rows.append((np.full(many.sum(), d), ctx[many].astype(np.int64), n[many]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)],
                                                 ["depth", "ctx", "n"])
    found = _sample_blocks(packed, blocks).mapInArrow(sample, "depth long, ctx long, n long").groupBy("depth", "ctx").agg(F.sum("n").alias("n"))
    # a context is over a quarter of the limit somewhere: at most 4 * grams / limit of a depth and block
    rows = found.collect()
    size = sum(r["n"] for r in rows if r["depth"] == 0)
    return {d: np.array([r["ctx"] for r in rows if r["depth"] == d and r["n"] * (total / size) > limit], np.uint64)
            for d in range(2, DEPTH)}


def _counts(of: np.ndarray, keep: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(of, keep, size).astype(np.int64)


def _key_counts(key: np.ndarray, keep: np.ndarray):
    uniq, of = np.unique(key, return_inverse=True)
    return uniq, _counts(of, keep, len(uniq))


def _gram_counts(key: np.ndarray, keep: np.ndarray):
    """Like ``_key_counts`` by one plain sort: a gram leaves its highest byte free, so the
    training mark rides in the lowest bit."""
    both = np.sort((key << np.uint64(1)) | keep)
    key = both >> np.uint64(1)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    return key[start], np.add.reduceat((both & np.uint64(1)).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)


class Block:
    """Texts of a block with the training mark of each row."""

    def __init__(self, data: bytes):
        t = B.unpack(data)
        self.ids, self.texts = t["id"].combine_chunks(), t["text"].combine_chunks()
        self.train = t["train"].to_numpy(zero_copy_only=False).astype(bool)

    def spans(self):
        """Row ranges of about ``SLICE_BYTES`` of text; a longer text is alone in its range."""
        offs = A.text_bytes(self.texts)[1]
        begin, rows = 0, len(offs) - 1
        for i in range(1, rows + 1):
            if i == rows or offs[i + 1] - offs[begin] > SLICE_BYTES:
                yield begin, i
                begin = i

    def _request(self, slices, counted):
        """Distinct keys of the block and their training counts, gathered slice by slice."""
        held, waiting = [], 0
        for key, keep in slices:
            held.append(counted(key, keep))
            waiting += len(held[-1][0])
            if waiting > 2 * len(held[0][0]) + SLICE_BYTES:
                held, waiting = [_summed(*[np.concatenate(c) for c in zip(*held)])[:2]], 0
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _summed(*[np.concatenate(c) for c in zip(*held)])[:2]

    @staticmethod
    def _places(slices):
        """Distinct keys of the block, and for each slice the distinct keys of its own and the
        place of every key among them (four bytes a key)."""
        own = []
        for key, _ in slices:
            uniq, of = np.unique(key, return_inverse=True)
            own.append((uniq, of.astype(np.uint32)))
        known = np.sort(np.concatenate([u for u, _ in own])) if own else np.zeros(0, np.uint64)
        first = np.ones(len(known), bool)
        first[1:] = known[1:] != known[:-1]
        return known[first], own

    def gram_slices(self):
        for a, b in self.spans():
            key, begin, _ = grams(self.texts.slice(a, b - a))
            yield key, np.repeat(self.train[a:b], np.diff(begin))

    def words(self, a: int, b: int):
        """(hash of every token, its text, the words) of a row range; ends come last."""
        w = A.find_words(self.texts.slice(a, b - a), lower=True)
        return (np.concatenate([A.word_hash(w, 3), np.repeat(_END_WORD, w.rows)]),
                np.concatenate([w.row, np.arange(w.rows)]), w)

    def word_slices(self):
        for a, b in self.spans():
            h, row, _ = self.words(a, b)
            yield h, self.train[a:b][row]

    def gram_request(self):
        return self._request(self.gram_slices(), _gram_counts)

    def word_request(self):
        return self._request(self.word_slices(), _key_counts)

    def answered(self, slices, ask):
        """For every slice the answers of its keys in text order: ``ask`` gets the block's
        distinct keys once; each slice looks its sorted distinct keys up among them."""
        known, own = self._places(slices)
        value = ask(known) if len(known) else np.zeros(0)
        for uniq, of in own:
            yield value[np.searchsorted(known, uniq)][of]


MERGED = ("bucket long, grams binary, blocks array<string>, places array<binary>, "
          "kind long, slot long, value double")
MERGED_NAMES = ["bucket", "grams", "blocks", "places", "kind", "slot", "value"]


def _summed(key: np.ndarray, n: np.ndarray):
    uniq, of = np.unique(key, return_inverse=True)
    return uniq, np.bincount(of, n, len(uniq)).astype(np.int64), of


def score(docs: DataFrame, train_rule: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    text's probability), bits_per_byte. ``train_rule``: condition for training rows."""
    d = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col),
                    F.coalesce(train_rule, F.lit(True)).alias("train"))
    packed = B.pack(d, id_col, text_col, "train")
    blocks, total = (x or 0 for x in packed.agg(F.count("*"), F.sum("n_bytes")).first())
    gram_buckets = max(16, -(-int(total * grams_a_byte(packed, blocks)) // GRAM_KEYS))
    word_buckets = B.bucket_count(total, WORDS_A_BYTE)
    split = Split(hot_contexts(packed, blocks, total, SPLIT_KEYS))
    data = packed.select("block", "data")

    def ask_grams(batches):
        for batch in batches:
            for name, blob in zip(batch.column("block").to_pylist(), batch.column("data")):
                key, n = Block(blob.as_py()).gram_request()
                yield B.dealt(name, key, gram_buckets, n.astype(np.uint32), by=split.bucket(key))

    def merge_bucket(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending")])
        parts = [B.unsqueeze(x) for x in t["data"].to_pylist()]
        size = [len(p[0]) for p in parts]
        key, n, of = _summed(*[np.concatenate(c) for c in zip(*parts)])
        del parts
        cut = np.cumsum([0, *size])
        merged = pa.table({"bucket": t["bucket"][:1], "grams": pa.array([B.squeeze(key, n)], pa.binary()),
                           "blocks": pa.array([t["block"].to_pylist()], pa.list_(pa.string())),
                           "places": pa.array([[B.squeeze(of[a:b].astype(np.uint32)) for a, b in zip(cut[:-1], cut[1:])]],
                                              pa.list_(pa.binary()))})
        kind, slot, value = split.sums(key[n > 0], n[n > 0])
        sums = pa.table({"kind": kind.astype(np.int64), "slot": slot.astype(np.int64), "value": value})
        return pa.concat_tables([merged, sums], promote_options="default").select(MERGED_NAMES)
    buckets = B.staged(data.mapInArrow(ask_grams, B.REQUEST).groupBy("bucket").applyInArrow(merge_bucket, MERGED))
    # at most 9 * 2**16 rows, and 511 of each hot context
    done = Split(split.hot)
    done.finish(buckets.filter("grams is null").groupBy("kind", "slot").agg(F.sum("value")).collect())

    def code_lengths(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, blocks, grams, places = (batch.column(c)[row].as_py() for c in ("bucket", "blocks", "grams", "places"))
                key, n = B.unsqueeze(grams)
                bits = done.code_lengths(key, n).astype(np.float32).view(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(blocks), pa.int64()), pa.array(blocks, pa.string()),
                     pa.array([B.squeeze(bits[B.unsqueeze(p)[0]]) for p in places], pa.binary())],
                    ["bucket", "block", "data"])
    grams_back = buckets.filter("grams is not null").select("bucket", "blocks", "grams", "places").mapInArrow(code_lengths, B.ANSWER)

    def ask_words(batches):
        for batch in batches:
            for name, blob in zip(batch.column("block").to_pylist(), batch.column("data")):
                h, n = Block(blob.as_py()).word_request()
                yield B.dealt(name, h, word_buckets, n.astype(np.uint32))

    def word_counts(cols, _):
        h, n = cols
        _, n, of = _summed(h, n.astype(np.int64))
        first = np.zeros(len(of), np.int64)
        first[np.unique(of, return_index=True)[1]] = 1
        return [n[of], first]                # count everywhere, and one mark per distinct word
    words_back = B.staged(B.answers(data.mapInArrow(ask_words, B.REQUEST), word_counts))

    def totals(batches):
        for batch in batches:
            tokens = kinds = 0
            for x in batch.column("data").to_pylist():
                n, first = B.unsqueeze(x)
                tokens, kinds = tokens + int((n * first).sum()), kinds + int((first * (n > 0)).sum())
            yield pa.RecordBatch.from_pydict({"n": [tokens], "v": [kinds]})
    whole = words_back.mapInArrow(totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    train_tokens, distinct = int(whole[0] or 0), int(whole[1] or 0)

    def finish(text: pa.Table, got: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        done = []
        for blob in text["data"]:
            block = Block(blob.as_py())
            costs = block.answered(block.gram_slices(), lambda key: B.collected(
                got.filter(pc.equal(got["kind"], 1)), key, gram_buckets, by=split.bucket(key))[0].view(np.float32))
            counts = block.answered(block.word_slices(), lambda key: B.collected(
                got.filter(pc.equal(got["kind"], 2)), key, word_buckets)[0])
            for (a, b), cost, c in zip(block.spans(), costs, counts):
                w = A.find_words(block.texts.slice(a, b - a), lower=True)
                row = np.concatenate([w.row, np.arange(w.rows)])
                size = np.bincount(w.row, w.end - w.start + 1, w.rows).astype(np.int64) + 1
                cost = np.add.reduceat(cost.astype(np.float64), np.cumsum(size) - size)
                base = np.bincount(row, np.log10((c + 0.1) / (train_tokens + 0.1 * (distinct + 1))), w.rows)
                done.append(pa.table({
                    "doc_id": block.ids.slice(a, b - a), "held_out": pa.array(~block.train[a:b]),
                    "n_tokens": pa.array(w.counts.astype(np.int64) + 1),
                    "n_known": pa.array(np.bincount(row, c > 0, w.rows).astype(np.int64)),
                    "train_tokens": pa.array(np.full(w.rows, train_tokens)), "base_score": pa.array(base),
                    "score": pa.array(-cost * math.log10(2)), "bits_per_byte": pa.array(cost / size)}))
        return pa.concat_tables(done)
    both = (grams_back.select(F.col("block").alias("to"), F.lit(1).alias("kind"), "bucket", "data")
            .unionByName(words_back.select(F.col("block").alias("to"), F.lit(2).alias("kind"), "bucket", "data")))
    return data.groupBy("block").cogroup(both.groupBy("to")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double, bits_per_byte double")
