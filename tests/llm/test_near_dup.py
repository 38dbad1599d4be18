import random

import pytest

from stratafuse.llm import near_dup as X

SCHEMA = "doc_id long, text string, key long, comp string, members int"


def fixture():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows = []
    for g in range(6):
        base = [word() for _ in range(80)]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(80)] = word()
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(100, ""), (101, None), (102, "one two"), (103, "ONE  two"), (104, rows[0][1]), (105, "\t \n"), (106, " ".join(word() for _ in range(3000)))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, words, percent):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in X.near_duplicates(spark, df, words, percent).collect()}
    want = X.brute_force(rows, words, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert got[100]["n_shingles"] == got[101]["n_shingles"] == 0 and got[102]["n_shingles"] == 1


def test_null_repeated_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "A b c d")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in X.near_duplicates(spark, df, 3, 85).collect()), key=str)
    assert rows == [(7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)]
    assert X.near_duplicates(spark, df.limit(0), 3, 85).count() == 0


def test_pairs_of_shared_passages_are_bounded(spark, monkeypatch):
    r = random.Random(1)
    passages = [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(40)]
    tested, keep = {}, X.C.saved

    def saved(session, df, root, name, *more):
        out = keep(session, df, root, name, *more)
        if name.startswith("star-"):
            tested[name] = out.count()
        return out

    monkeypatch.setattr(X.C, "saved", saved)
    for n, most in ((300, 25), (900, 35)):
        rows = [(i, " ".join(r.sample(passages, 30))) for i in range(n)]
        tested.clear()
        got = X.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
        assert sum(tested.values()) < most * n
        if n == 300:
            assert {g["doc_id"]: g["component_id"] for g in got} == X.brute_force(rows, 3, 85)
