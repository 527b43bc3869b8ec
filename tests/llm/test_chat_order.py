"""Chat formatting against a plain reading of its rules: tied and null turns, null
conversations, repeated rows, conversations over many runs and parts."""

import random

from pyspark.sql import functions as F

from tidewell.llm import chat_format

SCHEMA = "conv_id long, turn int, role string, text string, lost boolean, run int, id1 long"


def expected(rows, part):
    def key(value):
        return (value is not None, value if value is not None else 0)
    convs = {}
    for c, t, r, x, *_ in set(rows):
        convs.setdefault(c, []).append((t, r, x))
    turns = {c: tuple((r if r is not None else "user", x if x is not None else "") for _, r, x in sorted(
        v, key=lambda e: (key(e[0]), (e[1] is not None, e[1] or ""), (e[2] is not None, (e[2] or "").encode()))))
        for c, v in convs.items()}
    prefixes = {v[:n] for v in turns.values() for n in range(1, len(v))}
    groups = {}
    for c, v in turns.items():
        groups.setdefault(v, []).append(c)
    out = set()
    for v, ids in groups.items():
        if v not in prefixes:
            keep = min(ids, key=lambda c: (c is None, c or 0))
            for p in range(0, len(v), part):
                text = "\n".join(f"<|{r}|>\n{x}\n<|end|>" for r, x in v[p:p + part])
                out.add((keep, p // part, len(v), len(ids), text))
    return out


def got(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = chat_format.render(t)
    found = [(r["conv_id"], r["part"], r["n_turns"], r["n_copies"], r["text"]) for r in out.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 3)
    rnd = random.Random(3)
    rows = []
    for c in [None, *range(40)]:
        for _ in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([None, 0, 1, 1, 2]), rnd.choice([None, "user", "bot"]),
                         rnd.choice([None, "", "a", "b", "é", "a" * 300 + "x", "a" * 300 + "b"]), True, 1, 2))
    rows += rows[:20] * 3
    assert got(spark, rows) == expected(rows, 3)


def test_long_conversations_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 100)
    long = [(i, "user" if i % 2 else "bot", f"text {i % 7}") for i in range(2500)]
    rows = [(c, t, r, x, None, 1, 2) for c, n in ((1, 2500), (2, 2499), (3, 2500), (None, 1200), (5, 1))
            for t, r, x in long[:n]]
    # a long conversation whose turns are all tied, and one whose turns are all null
    rows += [(7, 4, "user", f"tied {i}", None, 1, 2) for i in range(1500)]
    rows += [(8, None, None, f"null {i}", None, 1, 2) for i in range(1500)]
    assert got(spark, rows) == expected(rows, 100)
    runs = chat_format._ordered(chat_format._keyed(spark.createDataFrame(rows, SCHEMA)))
    assert runs.where("conv = 7").select(F.countDistinct("run")).first()[0] > 0


def test_text_is_shuffled_for_rendering_only(spark):
    t = spark.createDataFrame([(1, 0, "user", "a", None, 1, 2)], SCHEMA)
    slim = chat_format.prefix_hashes(chat_format._keyed(t))
    assert "text" not in slim.columns
    assert chat_format.render(t.limit(0)).count() == 0
