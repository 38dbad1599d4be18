"""The stages of the corpus pipeline against plain Python over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from stratafuse.llm import common as C
from stratafuse.llm import token_store, toxicity


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_toxicity(rows, model):
    def score(text):
        ids, _ = toxicity.word_ids([text])
        x = [sum(model.tables[k][ids[k, j]].astype(float) for k in range(3)) for j in range(ids.shape[1])]
        pooled, k = [], 0
        for i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = [sum(float(x[s + j] @ model.filters[k + j][:, f]) for j in range(w)) for s in range(len(x) - w + 1)]
                pooled.append(max([0.0, *(a + float(model.bias[i * toxicity.FILTERS + f]) for a in at)]))
            k += w
        return 1 / (1 + math.exp(-(float(np.dot(pooled, model.out)) + model.out_bias)))

    return [r for r in rows if score(r[1]) < model.thresholds.get(r[2], model.default)]


def plain_near_dedup(rows):
    def shingles(text):
        w = split((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if root(i) not in best or key < best[root(i)][0]:
            best[root(i)] = key, i
    return [rows[i] for _, i in best.values()]


def plain_decontaminate(rows, items):
    def normal(text):
        return split("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()))

    def covered(item, doc, least):
        item, doc, total = list(item), list(doc), 0
        while True:
            runs = []
            for i in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and item[i + n] is not None and item[i + n] == doc[d + n]:
                        n += 1
                    if n >= least:
                        runs.append((-n, i, d))
            if not runs:
                return total
            n, i, d = min(runs)
            item[i : i - n] = doc[d : d - n] = [None] * -n
            total -= n

    def leaks(doc, item):
        return item and 100 * covered(item, doc, min(4, len(item))) >= 60 * len(item)

    items = [normal(t) for i, t in items if i is not None]
    return [r for r in rows if not any(leaks(normal(r[1]), item) for item in items)]


def plain_mixing(rows):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(split(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, list(names), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2.0 * sizes[s]]
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            open_.remove(s)
    out = Counter()
    for s in names:
        copies = math.floor(target[s] / sizes[s] + 1e-12) if sizes[s] else 0
        left, by_hash = target[s] - copies * sizes[s], {}
        for r in rows:
            if r[3] == s:
                by_hash.setdefault(hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], []).append(r)
        below, closed = 0, False
        for h in sorted(by_hash):
            upto = below + sum(len(split(r[1])) for r in by_hash[h])
            more = not closed and (upto <= left or upto - left < left - below)
            closed, below = closed or upto > left, upto
            for r in by_hash[h]:
                out[r] += copies + more
    return +out


def test_stages_equal_plain_python(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
    word = lambda n: rng.choice(vocabulary, n).tolist()
    sources, rows, labels = ["a", "b", "c", None], [], []
    for i in range(300):
        rows.append((i, " ".join(word(12) + (["vile", "scum"] if i % 4 == 0 else []) + word(13)), "en" if i % 3 else "de", sources[i % 4 if i % 5 else 0]))
        labels.append((i, int(i % 4 == 0)))
    items = [(1, " ".join(word(18))), (2, " ".join(word(3))), (None, " ".join(word(9)))]
    planted = {"toxic": [], "copied": [], "leaking": [], "clean": []}
    for i in (None, 1000, 1000):  # each kind with a null and a repeated id
        planted["toxic"].append((i, " ".join(word(10) + ["vile", "scum"] + word(10)), "en", "a"))
        planted["leaking"].append((i, " ".join(word(7) + items[0][1].upper().split()[6:] + ["x."] + items[0][1].split()[:6] + word(7)), "en", "b"))
        planted["copied"].append((i, rows[5 if i else 7][1] + " tail", "en", "b"))
        planted["clean"].append((i, " ".join(word(30)), None, "c"))
    again = (1001, " ".join(word(25)), "en", "a")
    rows += [r for kind in planted.values() for r in kind] + [again, again, (1002, " ".join(["z", *items[1][1].split(), "z"]), "en", "c"), (1003, "", "en", "c"), (1004, None, "en", "c"), (1005, items[2][1], "en", "a")]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs, root, steps = C.documents(spark, sf), C.work_dir(spark), {}
    model = toxicity.fit(spark, docs, C.documents(spark, sf, "labels"))
    want, by_hand = rows, {"toxicity": lambda x: plain_toxicity(x, model), "near_dedup": plain_near_dedup, "decontaminate": lambda x: plain_decontaminate(x, items), "mixing": lambda x: list(plain_mixing(x).elements())}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.saved(spark, stage(spark, docs, sf), root, name)
        if name == "tokens":
            break
        before, want = want, by_hand[name](want)
        steps[name] = {tuple(r) for r in before} - {tuple(r) for r in want}
        assert Counter(tuple(r) for r in docs.collect()) == Counter(want), name
    assert steps["toxicity"] >= set(planted["toxic"]) and not steps["toxicity"] & {again, *planted["clean"]}
    assert steps["near_dedup"] == set(planted["copied"]) and {*planted["leaking"]} < steps["decontaminate"]
    assert not steps["decontaminate"] & {again, *planted["clean"]}

    t, got = Tokenizer.from_file(token_store.tokenizer_path()), sorted((tuple(r) for r in docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    ids = [(r[0], np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in want]
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    assert [r[0] for r in got] == sorted((i for i, _ in ids), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    run = corpus_pipeline.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted((tuple(r) for r in run.collect()), key=lambda r: r[1]) == got


def test_pipeline_of_empty_tables(spark, tmp_path):
    names = ("documents", "labels", "benchmark")
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in names}

    def result(empty):
        folder = f"{tmp_path}/without-{empty}"
        for n, t in tables.items():
            (t.limit(0) if n == empty else t).write.parquet(f"{folder}/{n}.parquet")
        return corpus_pipeline.run(spark, folder).count()

    assert result("documents") == 0
    docs = corpus_pipeline.stage_near_dedup(spark, tables["documents"], "").count()
    for empty in ("labels", "benchmark"):  # nothing is rejected for want of labels or items
        assert result(empty) > 0.8 * docs
