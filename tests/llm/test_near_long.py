"""Near-dedup of long texts, with cells and parts cut by the bytes of their sets."""

import random

from tidewell.llm import near_dedup
from tidewell.llm.common import importable


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size, share):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= share * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_twenty_thousand_word_copies_in_small_blocks(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(near_dedup, "CELL", 4)
    monkeypatch.setattr(near_dedup, "SET_BYTES", 2048)
    rnd = random.Random(11)
    rows = []
    for words, copies in ((20000, 6), (300, 30), (40, 20)):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            v = list(base)
            for _ in range(rnd.randrange(0, max(2, words // 25))):
                v[rnd.randrange(len(v))] = f"x{rnd.randrange(10 ** 6)}"
            rows.append((len(rows) + 1, " ".join(v)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "one", "one two"], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           near_dedup.near_duplicates(docs, size=3, share=85).collect()}
    assert got == components(rows, 3, 85)
