import numpy as np
import pytest

from stratafuse.llm import repeats as X

SCHEMA = "doc_id long, text string, lang string, uid int, piece string"


def rows_of(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in X.remove_repeats(spark, df, **kw).collect()}


def fixture():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcdéf"), 4)) for _ in range(n))
    common = word(12)
    rows = [(i, f"{word(6)} {common} {word(6)}") for i in range(40)]
    rows += [(50, "a" * 300), (51, ""), (52, None), (53, word(3)), (54, rows[0][1]), (55, rows[1][1][10:70]), (56, word(400)), (57, common + " " + common)]
    return rows


@pytest.mark.parametrize("crowd", [3, 500])
def test_against_brute_force(spark, crowd):
    rows = fixture()
    assert rows_of(spark, rows, length=24, context=12, crowd=crowd) == X.brute_force(rows, 24)


def test_index_against_counts():
    rng = np.random.default_rng(0)
    for length in (5, 9):
        for _ in range(20):
            base = bytes(rng.integers(97, 99, 60, dtype=np.uint8))
            strings = [base[int(rng.integers(0, 20)) : int(rng.integers(20, 60))] + bytes(rng.integers(97, 99, int(rng.integers(0, 10)), dtype=np.uint8)) for _ in range(6)]
            count = {}
            for x in strings:
                for i in range(len(x) - length + 1):
                    count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
            for x, got in zip(strings, X.repeated_starts(strings, length), strict=True):
                assert got.tolist() == [count[x[i : i + length]] > 1 for i in range(len(x) - length + 1)]


def test_empty_table(spark):
    assert rows_of(spark, []) == {}


def test_planted_passages_at_contract_length(spark):
    """Passages of over 50 words: those of 400 bytes and more are removed from both documents, one of 399 bytes
    isn't; n_bytes is the text's length for all of them."""
    rng = np.random.default_rng(9)
    words = lambda n, k: " ".join("".join(rng.choice(list("abcdefgh"), k)) for _ in range(n))
    fill = iter([f"{a}{words(70, 6)}{b}" for a, b in zip("ABCDEFGHIJKLMNOP", "QRSTUVWXYZabcdef", strict=True)])
    passages = [words(60, 9), "<" + words(57, 6) + ">", words(57, 6) + ">", words(51, 5)]
    assert [len(x) for x in passages] == [599, 400, 399, 305]
    rows = [(2 * i + j, f"{next(fill)}{x}{next(fill)}") for i, x in enumerate(passages) for j in (0, 1)]
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in [*rows, (8, words(200, 6)), (9, words(40, 6))]], SCHEMA)
    got = {r["doc_id"]: r for r in X.remove_repeats(spark, df).collect()}
    assert all(got[i]["n_bytes"] == len(t) for i, t in rows)
    assert [(got[i]["n_removed"], got[i]["n_spans"], got[i]["repeated"]) for i in range(10)] == [(599, 1, True)] * 2 + [(400, 1, True)] * 2 + [(0, 0, False)] * 6


def passage_flags(rows, k):
    """Which rows hold k words in a row that another row holds too, by counting all windows."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in ((t or "").split() for _, t in rows)]
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    return [any(count[x] > 1 for x in s) for s in sets]


def test_shared_passages_below_400_bytes(spark):
    """Passages of over 50 words that repeat across documents are told though they have fewer bytes than are removed."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    plain, short, own, blank = words(55), words(50), words(60), words(52)
    rows = [(i, f"{words(80)} {plain} {words(80)}") for i in range(30)]
    rows += [(30 + i, f"{words(80)} {short} {words(80)}") for i in range(5)]
    rows += [(40, f"{own} {words(9)} {own}"), (41, blank + " " + words(70)), (42, words(70) + "\n" + blank.replace(" ", "\t\n")), (43, None), (44, ""), (45, words(400)), (46, words(300))]
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in X.remove_repeats(spark, df).collect()}
    assert [got[i]["shares_passage"] for i, _ in rows] == passage_flags(rows, 51) == [i < 30 or i in (41, 42) for i, _ in rows]
    assert [i for i, r in got.items() if r["n_removed"]] == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_against_counts(spark, seed):
    """Small vocabularies, copies with edits, runs of one word, repeated rows."""
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(list("abcdefghijklmnopqrst"), int(rng.integers(1, 60)))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = base[i].split()
        w[int(rng.integers(len(w)))] = "zz"
        rows.append((200 + i, "  ".join(w[int(rng.integers(0, 5)) :])))
    rows += [(300, "a " * 50), (301, "a " * 9), (302, "b " * 50), rows[0], rows[1]]
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    for k, context in ((8, 3), (12, 6)):
        got = sorted((r["doc_id"], r["shares_passage"]) for r in X.remove_repeats(spark, df, passage=k, passage_context=context).collect())
        assert got == sorted(zip([i for i, _ in rows], passage_flags(rows, k), strict=True))
