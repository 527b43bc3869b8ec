"""Operators against brute force on small tables with nulls, empty and long texts, ties,
repeated rows, clashing extra columns and no rows at all."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    language_id,
    lm_score,
    mixing,
    near_dedup,
    substring_dedup,
    token_count,
    toxicity,
)
from tidewell.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, _id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(300)]

    def words(n):
        return [rnd.choice(vocab) for _ in range(n)]
    base = words(120)
    texts = [" ".join(words(n)) for n in (1, 2, 3, 10, 25, 60, 400)]
    for edits in (0, 1, 2, 3, 4, 5, 6, 8):
        v = list(base)
        for _ in range(edits):
            v[rnd.randrange(len(v))] = rnd.choice(vocab) + "x"
        texts.append(" ".join(v))
    passage = words(30)
    texts += [" ".join(words(15) + passage + words(9)) for _ in range(3)]
    texts += ["", None, " \t\n", "same  text\there", "same text here", "Same text here", "é ü 你好 word", "a b " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[9])]
    return [(i, t, "en", ["b", "a", None][k % 3], 0, "x", 1, 2) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BIG = (1 << 63) - 1


def by_id(rows, *cols):
    return sorted((BIG if r["doc_id"] is None else r["doc_id"], *[r[c] for c in cols]) for r in rows)


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(BIG if i is None else i)
    want = sorted((i, min(g), len(g), i == min(g)) for g in groups.values() for i in g)
    got = exact_dedup.assign(docs).collect()
    assert sorted((BIG if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.assign(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.assign(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("levels", [1, 3])
def test_exact_dedup_merges_sorted_runs(docs, levels):
    dig = exact_dedup.staged(exact_dedup.digests(docs))
    tree = exact_dedup.resolve(dig, levels)
    plan = tree._jdf.queryExecution().executedPlan().toString()
    # the way down reads the keys of a level only, which a hash aggregate may do
    assert "SortAggregate(key=[_run" in plan and not re.search(r"HashAggregate\([^\n]*functions=\[[^\n]*min\(", plan)
    got = sorted((r["_sha"], r["_first"] is None, r["_first"] or 0, r["_n"]) for r in tree.collect())
    groups = {}
    for r in dig.collect():
        groups.setdefault(r["_sha"], []).append(r["_id"])
    least = {s: min((i is None, i or 0) for i in ids) for s, ids in groups.items()}
    assert got == sorted((s, *least[s], len(ids)) for s, ids in groups.items() for _ in ids)


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, t, *_ in corpus()]
    want = sorted((BIG if i is None else i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)))
                  for i, t in rows)
    assert by_id(token_count.token_counts(docs, path).collect(), "n_bytes", "n_tokens") == want
    assert token_count.token_counts(empty, path).count() == 0
    text = "we<|endoftext|>'re HERE's 12½ ＡＢ naïve 　x"
    one = docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_count.token_counts(one, path).first()["n_tokens"] == len(tok.encode(text, add_special_tokens=False))
    other = public_tokenizers.path("byte_bpe_50k.json")        # keeps white space: long texts are split
    tok = Tokenizer.from_file(other)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, other).collect()}
    assert all(got[i] == len(tok.encode(t or "")) for i, t in rows if i is not None)


def test_substring_dedup(docs, empty):
    seen, want = set(), []
    for i, t in sorted(((BIG if i is None else i, t) for i, t, *_ in corpus()), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.dedup_substrings(docs, with_text=True).collect()
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == sorted(want)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_edges_use_the_second_hash(monkeypatch):
    """Where the first word hash cannot tell words apart, edges still do."""
    import numpy as np
    import pyarrow as pa
    word_hash = substring_dedup.A.word_hash
    monkeypatch.setattr(substring_dedup.A, "word_hash",
                        lambda w, seed=1: np.ones(len(w.start), np.uint64) if seed == 1 else word_hash(w, seed))
    t = pa.table({"id": [1, 2], "text": [" ".join(f"{c}{k}" for k in range(30)) for c in "ab"]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    b = substring_dedup.Block(sink.getvalue().to_pybytes(), 20)
    edges = b.into[b.into > 0]
    assert len(edges) > 2 and len(np.unique(edges)) == len(edges)


def test_near_dedup(docs, empty):
    rows = [(BIG if i is None else i, t) for i, t, *_ in corpus()]
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()))
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 85 * len(x | y):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {c: min(s[0] for s, d in zip(sets, comp) if d == c) for c in comp}
    want = sorted((s[0], len(s[1]), least[c]) for s, c in zip(sets, comp))
    got = near_dedup.near_duplicates(docs, size=3, share=85).collect()
    assert sorted((BIG if r[0] is None else r[0], r[1], BIG if r[2] is None else r[2]) for r in got) == want
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_keeps_one_with_null_and_repeated_ids(spark):
    importable(spark)
    rnd = random.Random(11)

    def variants(n):
        w = [f"w{rnd.randrange(10 ** 6)}" for _ in range(200)]
        return [" ".join(w[:k] + ["changed"] + w[k + 1:]) for k in range(60, 60 + 5 * n, 5)]
    null, same, full, plain = (variants(3) for _ in range(4))
    rows = [(None, t) for t in null] + [(4, t) for t in same] + [(9, t) for t in full[1:]] + [(7, full[0])] * 2
    rows += [(20 + k, t) for k, t in enumerate(plain)] + [(None, ""), (None, ""), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in near_dedup.keep_representatives(docs).collect()]
    assert sum(t in null for _, t in kept) == 1 and sum(t in same for _, t in kept) == 1
    assert [r for r in kept if r[1] in full] == [(7, full[0])] and [r for r in kept if r[1] in plain] == [(20, plain[0])]
    assert sum(not t for _, t in kept) == 4 and len(kept) == 8      # empty texts link with nothing
    # the query's mark is doc_id = component_id, so rows that share a component's id are marked alike
    marked = near_dedup.near_duplicates(docs).filter("kept <=> (doc_id <=> component_id)")
    assert marked.count() == docs.count()


def test_decontaminate(docs, empty, spark):
    texts = [t for _, t, *_ in corpus()]
    w = WORD.findall(texts[6])
    items = spark.createDataFrame([("i2", " ".join(w[50:64])), ("i1", " ".join(w[55:62])), ("i3", None), ("i4", ""),
                                   ("i5", "words nobody wrote anywhere at all, ever, in no document"), ("i1", " ".join(w[55:62]))],
                                  "item_id string, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.mark(docs, items).collect()}
    hit = [k for k, r in got.items() if r["contaminated"]]
    assert hit == [(6, 400)] and got[hit[0]]["n_hit"] == 14 and got[hit[0]]["n_items"] == 2
    assert got[hit[0]]["items_sha256"] == hashlib.sha256(b"i1,i2").hexdigest()
    left = decontaminate.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontaminate.mark(empty, items).count() == 0
    assert decontaminate.mark(docs, items.limit(0)).filter("contaminated").count() == 0


def test_lm_score(docs, empty):
    rows = lm_score.score(docs, F.col("doc_id") % 10 != 0).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 for r in rows)
    assert lm_score.score(empty, F.lit(True)).count() == 0
    none = lm_score.score(docs, F.lit(False)).filter("doc_id = 1").first()
    assert abs(none["bits_per_byte"] - 8) < 1e-6 and none["train_tokens"] == 0


def test_lm_score_uses_six_context_bytes(spark):
    """The byte after "bcdef" is given by the sixth byte before it only: a model of five
    bytes pays one more bit for every word of eight bytes."""
    importable(spark)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["pbcdefx", "qbcdefy"]) for _ in range(200))) for i in range(40)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 10 != 0)
    held = [r["bits_per_byte"] for r in got.filter("held_out").collect()]
    assert len(held) == 4 and max(held) < 0.19


def test_lm_score_splits_hot_contexts(docs, monkeypatch):
    """A two-byte context with many grams is dealt to several buckets, with equal scores."""
    rule = F.col("doc_id") % 10 != 0
    whole = by_id(lm_score.score(docs, rule).collect(), "score")
    made = []
    split = lm_score.Split
    monkeypatch.setattr(lm_score, "hot_contexts", lambda packed, blocks, total, limit, f=lm_score.hot_contexts: made.append(
        f(packed, blocks, total, limit)) or made[0])
    monkeypatch.setattr(lm_score, "SPLIT_KEYS", 8)
    parts = by_id(lm_score.score(docs, rule).collect(), "score")
    hot = split(made[0]).hot
    assert len(hot[2]) > 5 and len(hot[3]) > 0
    import numpy as np
    key = (hot[2][0] << np.uint64(40)) | (np.arange(97, 107, dtype=np.uint64) << np.uint64(32))
    assert len(set((split(made[0]).bucket(key) % np.uint64(16)).tolist())) > 3
    assert len(whole) == len(parts) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 * abs(a[1]) for a, b in zip(whole, parts))


def test_lm_probabilities_sum_to_one():
    """Over all next bytes of a context the mixture is a distribution."""
    import numpy as np
    rnd = np.random.default_rng(1)
    d = lm_score.DEPTH
    seen = np.unique(rnd.integers(97, 101, 400).astype(np.uint64))
    ctx = int.from_bytes(b"abcabc"[:d], "big") << 8
    key = np.sort(np.concatenate([np.uint64(ctx) + np.arange(256, dtype=np.uint64)]))
    n = np.zeros(256, np.int64)
    n[seen.astype(int)] = [5, 1, 2, 7][:len(seen)]
    deep, places = lm_score._tree(key, n, d, 2)
    one = np.zeros((256, 256), np.int64)
    one[97] = n
    top = lm_score.Top(one, np.zeros((8, 1 << 16)))
    p = 2 ** lm_score._log_probability(deep, places, top, 2)
    assert abs(p.sum() - 1) < 1e-9 and p[100] > p[98] > p[5]


def test_toxicity_catches_gapped_words(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(vocab) for _ in range(30)]
        if i % 4 == 0:
            w[rnd.randrange(30)] = rnd.choice(["zgumpf", "kwazzick"])
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 0, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    probe = ["you z.g-u*m_p f", "k w a z z i c k", "kwaxzzick", "zgumpfs", "Zgumpf!", vocab[0] + " " + vocab[1], "", None]
    t = spark.createDataFrame([(k, p) for k, p in enumerate(probe)], "doc_id long, text string")
    got = [r[0] for r in t.orderBy("doc_id").coalesce(1).select(toxicity.toxicity_score(F.col("text"), model)).collect()]
    assert got[1] >= 0.3 and got[2] >= 0.3 and got[3] >= 0.3 and got[4] >= 0.3
    assert max(got[5:]) < 0.3
    nothing = toxicity.train(docs, lab.limit(0))
    assert docs.select(toxicity.toxicity_score(F.col("text"), nothing).alias("s")).agg(F.max("s")).first()[0] == 0


def test_language_id(spark, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the house and the garden with that thing " * 3, "en"), ("das haus und der garten mit dem ding " * 3, "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, "und der mit", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:40])
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"]
    assert language_id.train(empty) is None and language_id.identify(empty, None).count() == 0


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    taken, size, goal = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        size[r["source"]], goal[r["source"]] = r["source_size"], r["target"]
    assert len(rows) == docs.count() and abs(sum(goal.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(goal[s] <= 3 * size[s] + 1e-6 for s in goal)
    longest = max(r["size"] for r in rows)              # whole copies round to half a document at worst
    assert all(abs(taken[s] - goal[s]) <= longest / 2 + 1 for s in goal)
    assert mixing.mix(empty).count() == 0
    assert mixing.replicate(docs).columns == [*docs.columns, "copy"]


def test_chat_format(spark):
    conv = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["x"], 5: [None, "y"], 6: ["a", "b", "d"], 7: ["a"]}
    rows = [(c, k * 2, "user" if k % 2 == 0 else None, t, "z") for c, ts in conv.items() for k, t in enumerate(ts)]
    t = spark.createDataFrame(rows + rows[:2], "conv_id long, turn int, role string, text string, pos string")
    got = {r["conv_id"]: r for r in chat_format.render(t).collect()}
    assert sorted(got) == [2, 4, 5, 6] and got[2]["n_copies"] == 2
    assert got[4]["text"] == "<|user|>\nx\n<|end|>" and got[5]["text"].startswith("<|user|>\n\n<|end|>")
    assert chat_format.render(t.limit(0)).count() == 0
    plan = chat_format.render(t)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    importable(spark)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n
