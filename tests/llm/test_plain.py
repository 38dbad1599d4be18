"""Operators that SQL can't express against plain versions: tiling, trees, the network, scanners, rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stratafuse.llm import decontaminate as D
from stratafuse.llm import pretokens as P
from stratafuse.llm import quality as Q
from stratafuse.llm import secrets as S
from stratafuse.llm import token_store as T
from stratafuse.llm import toxicity as X
from stratafuse.llm import url_filter as U

# ---------------------------------------------------------------- tiling


def plain_tiles(item, doc, least):
    """Greedy string tiling as published: the longest unmarked common run is marked, again and again
    (ties: first in the item, then in the document), until none of ``least`` words is left."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and free_i[i + k] and free_d[d + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        k, i, d = best
        if k < least:
            return out
        free_i[i : i + k] = free_d[d : d + k] = [False] * k
        out.append((i, d, k))


@pytest.mark.parametrize("most", [D.MOST_PAIRS, 7])
def test_tiles_against_greedy_tiling(monkeypatch, most):
    monkeypatch.setattr(D, "MOST_PAIRS", most)  # small: the path of texts with very many equal windows
    r = random.Random(2)
    for case in range(60):
        words = [r.randrange(2 if case % 3 == 0 else 6) for _ in range(r.randint(1, 24))]
        doc = [r.randrange(6) for _ in range(r.randint(0, 30))]
        at = r.randint(0, len(doc))
        doc[at:at] = words[r.randint(0, len(words)) :]
        got = D.tiles(np.array(words, np.uint64), np.array(doc, np.uint64), 3)
        want = plain_tiles(words, doc, 3)
        assert sum(k for *_, k in got) == sum(k for *_, k in want) and sorted(k for *_, k in got) == sorted(k for *_, k in want)
        assert all(words[i : i + k] == doc[d : d + k] for i, d, k in got)


def test_tiles_of_equal_words_are_bounded():
    item, doc = np.zeros(600, np.uint64), np.zeros(6000, np.uint64)
    assert sum(k for *_, k in D.tiles(item, doc)) == 600


def test_leaks_against_plain(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([2, 5, 30, 30, 40])]
    docs = []
    for n in range(40):
        text = [word() for _ in range(r.randint(0, 60))]
        _, words = items[n % 5]
        cut = sorted(r.sample(range(len(words) + 1), 2))
        parts = [words[: cut[0]], words[cut[0] : cut[1]], words[cut[1] :]]
        r.shuffle(parts)
        for p in parts[: r.randint(0, 3)]:
            at = r.randint(0, len(text))
            text[at:at] = p
        docs.append((n, " ".join(text)))
    want = set()
    for n, text in docs:
        for i, words in items:
            covered = sum(k for *_, k in plain_tiles(words, text.split(), min(D.MIN_TILE, len(words))))
            if 100 * covered >= D.COVER * len(words):
                want.add((n, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for limit in (D.BROADCAST_BYTES, 0):
        assert {(x["doc_id"], x["item_id"]) for x in D.find_leaks(spark, df, bench, broadcast_bytes=limit).collect()} == want
    assert D.find_leaks(spark, df.limit(0), bench).count() == D.find_leaks(spark, df, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- trees


def plain_boost(rows, edges, prior):
    """Boosted trees grown level by level from the same histograms, as loops over rows."""
    names = list(U.FEATURES)
    trees, margin = [], [prior] * len(rows)
    for _ in range(U.TREES):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - y for a, (y, _) in zip(p, rows, strict=True)], [a * (1 - a) for a in p]
        node, tree = ["r"] * len(rows), {}
        for _ in range(U.DEPTH):
            for name in sorted(set(node)):
                inside = [i for i, n in enumerate(node) if n == name]
                best, tg, th = (1e-6, None, None), sum(g[i] for i in inside), sum(h[i] for i in inside)
                for k in sorted(names):
                    for e in edges[k]:
                        left = [i for i in inside if rows[i][1][k] <= e]
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = a * a / (b + U.RIDGE) + (tg - a) ** 2 / (th - b + U.RIDGE) - tg**2 / (th + U.RIDGE)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, k, e)
                if best[1]:
                    tree[name] = best[1:]
                    for i in inside:
                        node[i] = name + ("0" if rows[i][1][best[1]] <= best[2] else "1")
        value = {n: -U.RATE * sum(g[i] for i, m in enumerate(node) if m == n) / (sum(h[i] for i, m in enumerate(node) if m == n) + U.RIDGE) for n in set(node)}
        margin = [m + value[n] for m, n in zip(margin, node, strict=True)]
        trees.append(tree)
    return margin


def test_trees_against_loops(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        f = {k: float(r.randint(0, 12)) for k in U.FEATURES}
        rows.append((float(f["length"] + f["depth"] + r.randint(0, 6) > 14), f))
    sample = spark.createDataFrame([(y, *[f[k] for k in U.FEATURES]) for y, f in rows], "label_value double, " + ", ".join(f"f_{k} double" for k in U.FEATURES)).repartition(3)
    model = U.fit(sample)
    got = sorted((tuple(x[1:]), x[0]) for x in sample.select(model.margin().alias("m"), *[f"f_{k}" for k in U.FEATURES]).collect())
    want = sorted((tuple(f[k] for k in U.FEATURES), m) for (_, f), m in zip(rows, plain_boost(rows, model.edges, model.prior), strict=True))
    assert np.allclose([m for _, m in got], [m for _, m in want], atol=1e-9) and len({m for _, m in got}) > 4


def test_held_out_urls(spark):
    auc, n = U.held_out_auc(spark, spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert n > 20 and auc > 0.8


# ---------------------------------------------------------------- network


def plain_scores(m, texts):
    """Every window of every width by itself: embed, filter, max over the text, logistic."""
    out = []
    for t in texts:
        ids, _ = X.word_ids([t])
        x = [sum(m.tables[k][ids[k, w]] for k in range(3)) for w in range(ids.shape[1])]
        pool, k = [], 0
        for i, w in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                best = 0.0
                for s in range(len(x) - w + 1):
                    best = max(best, float(sum(x[s + j] @ m.filters[k + j][:, f] for j in range(w)) + m.bias[i * X.FILTERS + f]))
                pool.append(best)
            k += w
        out.append(1 / (1 + math.exp(-(np.dot(pool, m.out) + m.out_bias))))
    return np.array(out)


def texts_of(n, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choice(["vile", "scum", "kind", "calm", "word", "Tree,", "über", "x"]) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_scores_against_plain(monkeypatch):
    texts = [*texts_of(40), "", None, "one"]
    m = X.train(texts_of(200), np.array([t.count("vile") > 1 for t in texts_of(200)], int), epochs=2)
    want = plain_scores(m, texts)
    assert np.allclose(m.score(texts), want, atol=1e-5)
    monkeypatch.setattr(X, "CHUNK", 16)  # texts cross the edges of chunks
    assert np.allclose(m.score(texts), want, atol=1e-5)


def test_gradient_against_differences(monkeypatch):
    """One step of AdaGrad moves each parameter against the slope of the loss, measured by differences."""
    texts = texts_of(24, 8)
    y = np.array([t.count("scum") > 1 for t in texts], int)
    rng = np.random.default_rng(7)
    start = X.train([], y[:0])
    # the parameters from which train() starts
    start.tables, start.filters = rng.normal(0, 0.1, start.tables.shape).astype(np.float32), rng.normal(0, 0.3, start.filters.shape).astype(np.float32)
    start.out = rng.normal(0, 0.3, start.out.shape).astype(np.float32)
    start.out_bias = float(np.log(y.mean() / (1 - y.mean())))
    after = X.train(texts, y, epochs=1, batch=len(texts), rate=1e-3)

    def loss():
        p = np.clip(plain_scores(start, texts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    checked = 0
    for name, place in [("out", (i,)) for i in range(0, 24, 3)] + [("filters", (k, d, f)) for k in range(6) for d, f in ((0, 0), (5, 3))]:
        p = getattr(start, name)
        old = p[place]
        p[place] = old + 1e-2
        up = loss()
        p[place] = old - 1e-2
        down = loss()
        p[place] = old
        slope, moved = (up - down) / 2e-2, getattr(after, name)[place] - old
        if abs(slope) > 2e-3:
            checked += 1
            assert np.sign(moved) == -np.sign(slope), (name, place)
            assert moved == pytest.approx(-1e-3 * slope / math.sqrt(1e-2 + slope**2), rel=0.15)
    assert checked > 6


# ---------------------------------------------------------------- scanners


def plain_spans(text):
    """The base kinds, read character by character."""
    out, n = [], len(text)
    word = lambda c: c.isascii() and (c.isalnum() or c in "+/_.=-")
    i = 0
    while i < n:
        hit = next((k for k in ("password", "passwd", "secret", "token", "apikey", "api_key") if text[i : i + len(k)].isascii() and text[i : i + len(k)].lower() == k), None)
        if hit:
            j = i + len(hit)
            j += j < n and text[j] in "\"'"
            while j < n and text[j] == " ":
                j += 1
            if j < n and text[j] in ":=":
                j += 1
                while j < n and text[j] == " ":
                    j += 1
                j += j < n and text[j] in "\"'"
                e = j
                while e < n and word(text[e]):
                    e += 1
                if e > j:
                    if e - j >= 6:
                        out.append((i, 0, e))
                    i = e
                    continue
        i += 1
    for kind, start, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < n:
            e = i + len(start)
            if text.startswith(start, i):
                while e < n and text[e] in allowed:
                    e += 1
                if e > i + len(start):
                    if e - i >= least:
                        out.append((i, kind, e))
                    i = e
                    continue
            i += 1
    return [(s, e, S.KINDS[k]) for s, k, e in sorted(out)]


def test_spans_against_scanner():
    r = random.Random(4)
    pieces = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "apiKey", "api-key", "AKIA", "AKIAAKIA" + "Z" * 14, "0a" * 12, "f" * 23, "ABCDEF123456", "x.y_z=/+", "é", "ſ", "K", "\n", "\t", *[" ", '"', "'", ":", "="] * 3]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 18)))
        assert [x for x in S.find_spans(text) if x[2] in ("assign", "access", "hex")] == plain_spans(text), repr(text)


# ---------------------------------------------------------------- rules


def plain_verdict(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    lines = [x for x in text.split("\n") if x.strip(Q.SPACE)]
    again = len(lines) - len(set(lines))
    bad = [2 * symbols > len(w), not 2 * len(w) <= chars <= 15 * len(w), 2 * again > len(lines), 2 * max(Counter(w).values(), default=0) > len(w), 2 * sum(c.isalpha() for c in text) < chars]
    return not any(bad)


def test_verdict_against_plain_and_order(spark):
    r = random.Random(6)
    bits = ["word", "another", "#", "%%", "1234", "x", "Straße", "line\n", "same line\n", "supercalifragilistic"]
    rows = [(i, " ".join(r.choice(bits[: r.randint(2, 10)]) + (str(r.randint(0, 9)) if r.random() < 0.5 else "") for _ in range(r.randint(0, 80)))) for i in range(400)] + [(None, None), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: (False if Q.base_failed(n) else plain_verdict(t or "")) for (i, t), n in zip(rows, Q.base_counts([t for _, t in rows])[0], strict=True)}
    first = {x["doc_id"]: x["kept"] for x in Q.judge_quality(spark, df).collect()}
    assert first == want and 0 < sum(want.values()) < len(want)
    backwards = Q._judge(Q.RULES[::-1])
    again = {x["doc_id"]: (x["kept"], x["rejected_by"]) for x in df.mapInArrow(backwards, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string").collect()}
    assert {i: k for i, (k, _) in again.items()} == want and all((by is None) == k for k, by in again.values())
    assert Q.judge_quality(spark, df.limit(0)).count() == 0
    cost = {r.name: (1.0, h, 100) for r, h in zip(Q.RULES, (1, 5, 3, 9, 2), strict=True)}
    assert [r.name for r in Q.by_worth(Q.RULES, cost)] == ["one_word", "word_length", "duplicate_lines", "letters", "symbols"]


# ---------------------------------------------------------------- tokens


def test_pretokens_against_the_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = T.tokenizer_path()
    plain, r = Tokenizer.from_file(path), random.Random(1)
    bits = ["a", "b", "Z", "é", "ß", " ", " ", " ", "\n", "\t", "'", "s", "t", "re", "ll", "ve", "'s", "1", "²", ".", ",", "!", "  ", "\n\n", "日本", "　", "😀", "́", "\x85", "\x1c", "\0", "<|endoftext|>", "\r\n", "-", "Ж", " ", "ꟊ", "word" * 9]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "\n", "'"]
    for keep, block in ((P.KEEP, P.BLOCK), (2000, 4096)):  # a small table is forgotten often, small blocks cut long texts
        monkeypatch.setattr(P, "BLOCK", block)
        ids, at = P.Encoder(path, keep).encode(pa.array([*texts, "the word " * 3000, "x" * 9000]))
        for i, t in enumerate([*texts, "the word " * 3000, "x" * 9000]):
            assert plain.encode(t or "", add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist(), repr(t)


def test_chunks_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n).astype("<u2") for n in (1, 16, 129, 5000, 20000)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = list(T.chunk_ends(np.concatenate(docs), at))
    alone = [next(T.chunk_ends(d, np.array([0, len(d)]))) for d in docs]
    assert together == alone and all(e[-1] == len(d) for e, d in zip(together, docs, strict=True))
    shifted = next(T.chunk_ends(np.concatenate([docs[0], docs[4]]), np.array([0, 20001])))
    assert len({e - 1 for e in shifted} & set(together[4])) > len(together[4]) // 2  # cuts follow the content
