"""Operators 11 to 13 against plain versions, and on nulls, repeated rows, empty and very long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratafuse.llm import alignment, lexical, packing, pretokens
from stratafuse.llm.token_store import tokenizer_path

SMALL = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 120_000
ODD = [(1, "one two three"), (1, "one two three"), (1, "other"), (None, "one two"), (None, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "x" * 300_000), (6, "É日本 \u0085 ſ Σσς İ 12½ don't DON'T '' 's"), (7, "a ▁ b"), (8, "<|endoftext|> <s> <|startoftext|>"), (9, "one▁two"), (10, "\x00 \x1c one")]
CLASH = "doc_id long, text string, row long, n long, term string, pairs string, length int, ids string, item_id string, bucket string"


def odd(spark):
    return spark.createDataFrame([(*r, *[None] * 8) for r in ODD], CLASH).repartition(3)


def random_texts(n, seed):
    r = random.Random(seed)
    pool = "abc ABC'sStTdDreLlvem 019  \n\téÉéİΣσẞÅͅ²½٣ 　 .,!?'\"#日本😀ᲐႠ̣́ﬁǅ\x00\x1c᠎\u0085"
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encoders_equal_the_libraries():
    texts = [t for _, t in ODD] + random_texts(3000, 3)
    given = [t or "" for t in texts]

    def check(coder, column, want):
        ids, at = coder.encode(column)
        for i, w in enumerate(want):
            assert ids[at[i] : at[i + 1]].tolist() == w, repr(given[i][:80])

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    check(pretokens.WordEncoder(tokenizer_path("word_bpe_49k.json")), pa.array(texts), [e.ids for e in plain.encode_batch_fast(given, add_special_tokens=False)])
    spaced = pa.array([" " + t for t in given])
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    check(pretokens.Encoder(tokenizer_path("byte_bpe_50k.json"), plain=True), spaced, [e.ids for e in plain.encode_batch_fast([" " + t for t in given], add_special_tokens=False)])
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    some = [i for i, t in enumerate(given) if t]
    given = [given[i] for i in some]
    check(pretokens.PieceEncoder(tokenizer_path("piece_bpe_32k.model")), spaced.take(pa.array(some)), pieces.encode(given))


# ---------------------------------------------------------------- packing


def check_packing(rows, texts, capacity=4096, cut=True):
    """rows: pieces; texts: (doc_id, text) of every document."""
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for doc, e in zip(texts, plain.encode_batch_fast([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        want[doc[0], np.array([*e.ids, 2], "<u4").tobytes()] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(bytes(r["ids"]))
        assert len(r["ids"]) == 4 * r["length"]
    total = sum(k * len(x) // 4 for (_, x), k in want.items())
    assert sum(r["length"] for r in rows) == total
    for (doc, ids), k in want.items():  # each id of each document once: its pieces follow each other
        at, n = 0, len(ids) // 4
        while at < n:
            fits = [x for x in pieces[doc, n, at] if ids[4 * at : 4 * at + len(x)] == x]
            assert len(fits) >= k
            at += len(fits[0]) // 4
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for s in sequences.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert 0 < end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    return padding, total, sequences


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    padding, *_ = check_packing(rows, texts)
    assert padding == 0
    query = packing.op11_harmonic_packing(spark, SMALL).collect()
    of = lambda r, crc: (r["doc_id"], r["start"], r["length"], crc, r["doc_tokens"])
    assert sorted(of(r, r["ids_crc32"]) for r in query) == sorted(of(r, zlib.crc32(r["ids"])) for r in rows)


def test_packing_of_odd_texts(spark):
    for capacity in (4096, 64):
        padding, *_ = check_packing(packing.pack(odd(spark), tokenizer_path("word_bpe_49k.json"), capacity).collect(), ODD, capacity)
        assert padding == 0
    assert packing.pack(odd(spark).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(odd(spark), tokenizer_path("word_bpe_49k.json"), 1000)


def test_packing_without_cuts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs.coalesce(2), tokenizer_path("word_bpe_49k.json"), 1000, cut=False).collect()
    _, _, sequences = check_packing(rows, texts, 1000, cut=False)
    full = 0
    for s in sequences.values():  # a bin of class k has k pieces, but for the last of a task
        (k,) = {1000 // n for _, n in s}
        full += len(s) == k
        assert len(s) <= k
    assert len(sequences) - full <= 2 * len({1000 // r["length"] for r in rows})


# ---------------------------------------------------------------- search


def plain_search(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(d, term.findall((t or "").translate(low))) for d, t in docs]
    count, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        found = []
        for at, (doc, t) in enumerate(terms):
            tf, m, score = Counter(t), 75 + 25 * len(t) * count // max(1, total), 0
            for x in term.findall((text or "").translate(low)):
                if tf[x]:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m))
            if score > 0:
                found.append((-score, -1 if doc is None else doc, at, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [lexical.BROADCAST_TERMS, 0])
def test_search_against_plain(spark, most):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = lexical.search(spark, docs, items, broadcast_terms=most).collect()
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 100


def test_search_of_odd_texts(spark):
    items = spark.createDataFrame([(1, "ONE one two"), (1, "ONE one two"), (None, "lorem É日本 12½"), (2, None), (3, ""), (4, "--"), (5, "unheard"), (6, "don"), (7, "x" * 300_000)], "item_id long, text string")
    want = plain_search(ODD, [(r["item_id"], r["text"]) for r in items.collect()], 3)
    got = lexical.search(spark, odd(spark), items, 3).collect()
    # documents of equal id and score stand in any order, with equal values
    assert sorted(map(tuple, got), key=str) == want
    for d, i in ((odd(spark).limit(0), items), (odd(spark), items.limit(0))):
        assert lexical.search(spark, d, i).count() == 0


def test_terms_of_adjacent_texts_and_shared_hashes(monkeypatch):
    texts = [b"ab", b"cd ab", b"", b"ab ab" * 3, b"x" * 40 + b" " + b"x" * 41, "é".encode()]
    at = np.cumsum([0, *map(len, texts)])
    a = np.frombuffer(b"".join(texts), np.uint8)

    def found():
        start, size, of, tf, n = lexical.term_counts(a, at)
        return {(d, a[s : s + k].tobytes()): c for s, k, d, c in zip(start.tolist(), size.tolist(), of.tolist(), tf.tolist(), strict=True)}, n.tolist()

    want = {(d, x): c for d, t in enumerate(texts) for x, c in Counter(re.findall(rb"[0-9a-z\x80-\xff]+", t)).items()}
    assert found() == (want, [1, 2, 0, 4, 2, 1])
    monkeypatch.setattr(lexical.C, "mix64", lambda x: np.zeros(len(x), np.uint64))
    assert found()[0] == want


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    plain, pieces = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(i): i for i in printable} | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in printable)}
    docs, count = [], Counter()
    for doc, text in texts:
        rows, groups = [], []
        if text:
            data = (" " + text).encode()
            a = [(i, bytes(back[c] for c in plain.id_to_token(i))) for i in plain.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in pieces.encode(text):
                p = pieces.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == data == b"".join(x for _, x in b):
                spans = []
                for side in (a, b):
                    at, out = 0, []
                    for i, x in side:
                        out.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(out)
                shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                place = [0, 0]
                for e in shared:
                    parts = []
                    for k, side in enumerate(spans):
                        first = place[k]
                        while place[k] < len(side) and side[place[k]][1] <= e:
                            place[k] += 1
                        parts.append(",".join(str(i) for _, _, i in side[first : place[k]]))
                    groups.append("|".join(parts))
                j = 0
                for s, t, i in spans[0]:
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(spans[1]) and spans[1][k][0] < t:
                        rows.append((i, spans[1][k][2]))
                        k += 1
                docs.append((doc, len(a), len(b), groups, rows))
                count.update(rows)
                continue
        docs.append((doc, 0, 0, [], []))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for doc, n_a, n_b, groups, rows in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc, n_a, n_b, len(groups), len(rows), sum(count[r] == best[r[1]] for r in rows), sum(count[r] for r in rows), digest


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def test_alignment_against_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(d, t[:3000]) for d, t in docs] + list(enumerate(random_texts(200, 9), 10_000))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = alignment.align(spark, df, *PATHS).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(plain_alignment(docs))
    sliced = alignment.align(spark, df, *PATHS, slice_pairs=1000).select(COLUMNS).collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, got))


def test_alignment_of_odd_texts(spark):
    want = sorted(plain_alignment([(d, t) for d, t in ODD if d != 4]), key=str)
    frame = odd(spark).where("doc_id is null or doc_id <> 4")
    assert sorted(map(tuple, alignment.align(spark, frame, *PATHS).select(COLUMNS).collect()), key=str) == want
    assert alignment.align(spark, odd(spark).where("doc_id = 4"), *PATHS).first()["n_groups"] > 100_000
    for empty in (frame.limit(0), frame.where("text is null or text = ''")):
        assert all(r["n_links"] == 0 and r["groups_sha256"] == "" for r in alignment.align(spark, empty, *PATHS).collect())
    groups = alignment.align(spark, frame.where("doc_id = 6"), *PATHS, digest=False).first()["groups"]
    assert hashlib.sha256(groups.encode()).hexdigest() == next(r[-1] for r in want if r[0] == 6)


def test_query_aligns_whole_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op13_token_alignment(spark, SMALL).select(COLUMNS).collect()
    want = sorted(plain_alignment(docs)) if sum(len(t or "") for _, t in docs) < 3_000_000 else None
    assert sorted(map(tuple, got)) == want


def test_each_interval_is_one_overlap():
    ends, ia, ib, shared = alignment.owners(np.array([2, 5, 6, 9]), np.array([1, 5, 7, 9]))
    assert ends.tolist() == [1, 2, 5, 6, 7, 9] and ia.tolist() == [0, 0, 1, 2, 3, 3] and ib.tolist() == [0, 1, 1, 2, 2, 3]
    assert ends[shared].tolist() == [5, 9]
