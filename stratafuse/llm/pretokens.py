"""Byte-level BPE for whole Arrow batches.

Texts are cut into pre-tokens by array operations on their UTF-8 bytes, each distinct
pre-token is encoded once, and the ids of all texts are gathered by their places. The cuts
are those of the usual byte-level pattern: contractions, an optional space before a run of
letters, of digits or of other characters, and white space, whose last character goes to
what follows. Texts with characters whose class depends on the Unicode version, or with
the strings of special tokens, go to the tokenizer as they are.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from stratafuse.llm import common as C

LETTER, DIGIT, SPACE, OTHER, UNSURE, UNKNOWN = range(6)
#: Bytes of text that are cut at once, and of encoded pre-tokens that a worker keeps.
BLOCK, KEEP = 1 << 20, 48 << 20
# The white space of the pattern.
_SPACES = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _visible() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {i: chr(i) if i in plain else chr(next(rest)) for i in range(256)}


_VISIBLE = _visible()


def _kind(code: int) -> int:
    if code in _SPACES:
        return SPACE
    if code == 0 or 0x1C <= code <= 0x1F or code == 0x180E:
        return UNSURE
    now, before = (u.category(chr(code))[0] for u in (unicodedata, unicodedata.ucd_3_2_0))
    of = {"L": LETTER, "N": DIGIT}
    return of.get(now, OTHER) if of.get(now) == of.get(before) else UNSURE


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without a copy, and the offsets of its texts (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    a = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return a, at - at[0]


def blocks(start: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(first, after the last) of the texts that start in the same ``size`` bytes."""
    first = np.flatnonzero(np.diff(start // size, prepend=-1))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(start)], strict=True))


class Classes:
    """Character classes of UTF-8 bytes; a character's later bytes have the class of its first."""

    def __init__(self):
        self.of_byte = np.array([_kind(i) if i < 0x80 else UNKNOWN for i in range(256)], np.uint8)
        self.of_code = np.full(0x110000, UNKNOWN, np.uint8)

    def __call__(self, a: np.ndarray) -> np.ndarray:
        out = self.of_byte[a]
        lead = np.flatnonzero(a >= 0xC0)
        if len(lead):
            first = a[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0x7F >> size)
            for k in (1, 2, 3):
                more = size > k
                code[more] = (code[more] << 6) | (a[lead[more] + k] & 0x3F)
            kind = self.of_code[code]
            if (kind == UNKNOWN).any():
                new = np.unique(code[kind == UNKNOWN])
                self.of_code[new] = [_kind(c) for c in new.tolist()]
                kind = self.of_code[code]
            for k in range(4):
                on = size > k
                out[lead[on] + k] = kind[on]
        return out


def cuts(a: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. starts: where the (non-empty) texts begin; kind: the bytes' classes."""
    n = len(a)
    text = np.zeros(n + 1, bool)
    text[starts] = text[n] = True
    run = text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    cut = run.copy()
    # white space before something else: its last character stands alone or, a plain space, joins it
    after = np.flatnonzero(run[1:n] & ~text[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    last = after - 1
    for _ in range(2):
        last -= (a[last] & 0xC0) == 0x80
    joins = a[last] == 0x20
    cut[last] = True
    cut[after[joins]] = False
    quote = np.flatnonzero(cut[:n] & run[:n] & (a == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~text[quote + 1]]
    if len(quote):
        one, two = a[quote + 1], a[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = (quote + 2 < n) & ~text[np.minimum(quote + 2, n)] & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        cut[quote[short | pair] + 1] = False
        cut[quote[short] + 2] = True
        cut[quote[pair] + 3] = True
    return np.flatnonzero(cut[:n])


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def keys(a: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of each pre-token as numbers."""
    padded = np.concatenate([a, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(a) + 9,), "<u8", padded, 0, (1,))
    return eight[start] & _MASKS[np.minimum(size, 8)], eight[start + 8] & _MASKS[np.clip(size - 8, 0, 8)]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of all rows, one after the other."""
    total = int(size.sum())
    step = np.ones(total, np.int64)
    some = np.flatnonzero(size)
    if total:
        ends = np.cumsum(size[some])
        step[0] = start[some[0]]
        step[ends[:-1]] = start[some[1:]] - start[some[:-1]] - size[some[:-1]] + 1
    return flat[np.cumsum(step)]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each hash, the first place of each group, and its hash; groups are sorted by hash."""
    group, distinct = pd.factorize(h)
    where = np.zeros(len(distinct), np.int64)
    where[group[::-1]] = np.arange(len(h) - 1, -1, -1)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[group], where[order], distinct[order]


class Encoder:
    """Texts to ids, with the ids of distinct pre-tokens kept up to ``keep`` bytes."""

    def __init__(self, path: str, keep: int = KEEP, plain: bool = False):
        """plain: the strings of special tokens in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        config = json.loads(self.tokenizer.to_str())
        pre = config["pre_tokenizer"] or {}
        self.split = self._known_form(config, pre)
        self.special = [] if plain else [x["content"].encode() for x in config["added_tokens"]]
        self.classes, self.keep = Classes(), keep
        self.model = self.tokenizer.model
        self._forget()

    def _known_form(self, config: dict, pre: dict) -> bool:
        """Whether texts may be cut by array operations; else the tokenizer gets whole texts."""
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config["normalizer"] and not config["post_processor"]

    def _cut(self, a: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return cuts(a, starts, kind)

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of short pre-tokens, and of each
        self.first = self.second = np.zeros(0, np.uint64)  # its bytes,
        self.at = self.size = np.zeros(0, np.int64)  # and its ids in flat
        self.flat, self.long = np.zeros(0, self.kind), {}
        self.held = 0

    def _pretoken_ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, which go straight to the model in the byte alphabet."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(x.decode("latin-1").translate(_VISIBLE))] for x in words]

    def _text_ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _rows(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes in the table, -1 for unknown ones."""
        if not len(self.known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def _learn(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[bytes]) -> None:
        """Add pre-tokens (of distinct new hashes) to the table."""
        ids = self._pretoken_ids(words)
        size = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.kind, int(size.sum()))])
        place = np.searchsorted(self.known, h)
        self.known, self.first, self.second, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.known, h), (self.first, lo), (self.second, hi), (self.at, at), (self.size, size)))
        self.held = 40 * len(self.known) + self.flat.nbytes + sum(len(w) + 300 for _, w in self.long)

    def _block(self, a: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at ``starts``, and how many each has; those of ``whole`` and unsure ones aren't cut."""
        start, uncut = starts, whole
        if not whole.all():
            kind = self.classes(a)
            start = self._cut(a, starts, kind)
            unsure = np.flatnonzero(kind == UNSURE)
            if len(unsure) or whole.any():
                whole = whole.copy()
                whole[np.searchsorted(starts, unsure, "right") - 1] = True
                start = start[~whole[np.searchsorted(starts, start, "right") - 1] | np.isin(start, starts)]
            uncut = np.zeros(len(start), bool)
            uncut[np.searchsorted(start, starts[whole])] = True
        size = np.diff(start, append=len(a))
        lo, hi = keys(a, start, size)
        h = C.mix64(lo ^ C.mix64(hi + size.astype(np.uint64)))
        if self.held > self.keep:
            self._forget()
        group, where, distinct = _groups(h)
        row = self._rows(distinct)
        short = (size <= 16) & ~uncut
        new = (row < 0) & short[where]
        w = where[new]
        if len(w):
            self._learn(distinct[new], lo[w], hi[w], [a[s : s + k].tobytes() for s, k in zip(start[w].tolist(), size[w].tolist(), strict=True)])
            row = self._rows(distinct)
        row = row[group]
        odd = (row < 0) | ~short | (self.first[row] != lo) | (self.second[row] != hi) if len(self.known) else np.ones(len(h), bool)
        at, count = (self.at[row], self.size[row]) if len(self.known) else (np.zeros(len(h), np.int64), np.zeros(len(h), np.int64))
        flat = self.flat
        odd = np.flatnonzero(odd)
        if len(odd):  # whole texts, long pre-tokens, and the rare ones that share a hash with another
            words = [(bool(uncut[i]), a[start[i] : start[i] + size[i]].tobytes()) for i in odd.tolist()]
            lacking = [x for x in dict.fromkeys(words) if x not in self.long]
            more: dict[tuple[bool, bytes], list[int]] = {}
            for kept, ids_of in ((True, self._text_ids), (False, self._pretoken_ids)):
                part = [x for x in lacking if x[0] == kept]
                more |= zip(part, ids_of([x[1] for x in part]), strict=True)
            got = [more[x] if x in more else self.long[x] for x in words]
            self.long |= {x: y for x, y in more.items() if len(x[1]) <= 256}
            sizes = np.array([len(x) for x in got], np.int64)
            at[odd], count[odd] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(got), self.kind, int(sizes.sum()))])
        ids = gather(flat, at, count)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(start, np.append(starts, len(a)))])

    def _parts(self, a: np.ndarray, at: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, start, end) of the texts; long ones are cut before a space between two letters, where a pre-token always begins."""
        for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            while e - s > BLOCK and not whole[i]:
                look, cut = BLOCK // 16, 0
                while not cut and s + BLOCK - 2 < e:
                    x = a[s + BLOCK - 2 : min(e, s + BLOCK - 2 + look)]
                    letter = ((x | 0x20) >= 0x61) & ((x | 0x20) <= 0x7A)
                    found = np.flatnonzero(letter[:-2] & (x[1:-1] == 0x20) & letter[2:])
                    if len(found):
                        cut = s + BLOCK - 2 + int(found[0]) + 1
                    elif s + BLOCK - 2 + look >= e:
                        break
                    look *= 4
                if not cut:
                    break
                yield i, s, cut
                s = cut
            if e > s:
                yield i, s, e

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, and the offsets of each text's (null: none)."""
        a, at = utf8(column)
        return self._encode(a, at, self._whole(a, at))

    def _whole(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that go to the tokenizer as they are."""
        data = a.tobytes() if self.special and self.split else b""
        if any(x in data for x in self.special):
            return np.array([any(data.find(x, s, e) >= 0 for x in self.special) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
        return np.full(len(at) - 1, not self.split)

    def _encode(self, a: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(at) - 1
        pieces: list[np.ndarray] = []
        counts = np.zeros(n, np.int64)
        held: list[tuple[int, int, int]] = []

        def flush() -> None:
            if held:
                texts, first = np.array([i for i, *_ in held]), held[0][1]
                ids, sizes = self._block(a[first : held[-1][2]], np.array([s for _, s, _ in held]) - first, whole[texts])
                pieces.append(ids)
                np.add.at(counts, texts, sizes)
                held.clear()

        for i, s, e in self._parts(a, at, whole):
            if held and e - held[0][1] > BLOCK:
                flush()
            held.append((i, s, e))
        flush()
        return np.concatenate(pieces) if pieces else np.zeros(0, self.kind), np.concatenate([[0], np.cumsum(counts)])


def word_cuts(a: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens of lower-cased word vocabularies begin: contractions, runs of letters, single digits, runs
    of other characters; runs of white space are cut too and have no ids."""
    n = len(a)
    text = np.zeros(n + 1, bool)
    text[starts] = text[n] = True
    cut = text.copy()
    cut[1:n] |= (kind[1:] != kind[:-1]) | ((kind[1:] == DIGIT) & ((a[1:] & 0xC0) != 0x80))
    quote = np.flatnonzero(cut[:n] & (a == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~text[quote + 1]]
    if len(quote):
        last = np.minimum(quote + 2, n - 1)
        one, two = a[quote + 1], a[last]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = (quote + 2 < n) & ~text[last] & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        cut[quote[short | pair] + 1] = False
        cut[quote[short] + 2] = True
        cut[quote[pair] + 3] = True
    return np.flatnonzero(cut[:n])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class WordClasses(Classes):
    """Classes of characters for :class:`WordEncoder`: also unsure are marks that composition may know or not, and the
    capital sigma, whose lower case depends on its place in some libraries."""

    def __init__(self):
        super().__init__()
        marks = [i for i in range(0x80, 0x110000) if unicodedata.category(chr(i))[0] == "M" and unicodedata.ucd_3_2_0.category(chr(i)) == "Cn"]
        self.of_code[[*marks, 0x3A3]] = UNSURE


class WordEncoder(Encoder):
    """Vocabularies of lower-cased words with word ends: texts are composed (NFC) and lower-cased, then cut by
    :func:`word_cuts`."""

    def __init__(self, path: str, keep: int = KEEP, plain: bool = False):
        super().__init__(path, keep, plain)
        self.classes = WordClasses()

    def _known_form(self, config: dict, pre: dict) -> bool:
        steps = [x.get("type") for x in (config["normalizer"] or {}).get("normalizers", [])]
        parts = [x.get("type") for x in pre.get("pretokenizers", [])]
        # Fixed value: the pattern that word_cuts() stands for.
        same = parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        return same and steps == ["NFC", "Replace", "Lowercase"] and not config["post_processor"]

    def _cut(self, a: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return word_cuts(a, starts, kind)

    def _pretoken_ids(self, words: list[bytes]) -> list[list[int]]:
        spaces = [ord(x[:4].decode(errors="ignore")[0]) in _SPACES for x in words]
        found = iter(super()._pretoken_ids([x for x, s in zip(words, spaces, strict=True) if not s]))
        return [[] if s else next(found) for s in spaces]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        a, at = utf8(column)
        whole = self._whole(a, at)
        if whole.all():
            return self._encode(a, at, whole)
        whole[np.searchsorted(at, np.flatnonzero(self.classes(a) == UNSURE), "right") - 1] = True
        wide = np.zeros(len(whole), bool)
        wide[np.searchsorted(at, np.flatnonzero(a >= 0x80), "right") - 1] = True
        low, parts = _LOWER[a], []
        for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if whole[i]:
                parts.append(a[s:e].tobytes())
            elif wide[i]:
                parts.append(unicodedata.normalize("NFC", a[s:e].tobytes().decode()).lower().encode())
            else:
                parts.append(low[s:e].tobytes())
        return self._encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]), whole)


class PieceEncoder(Encoder):
    """Ids of texts that begin with a space by a sentencepiece model that adds that space itself. No piece of the model goes
    on after the end of a word, so each space after another character begins a pre-token."""

    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.kind = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.space = self.model.piece_to_id("\u2581")
        self.split = not any("\u2581" in x.lstrip("\u2581") for x in self.pieces) and self.pieces[self.space] == "\u2581"
        self.special, self.keep = ["\u2581".encode()], keep  # taken for a space
        self._forget()

    def classes(self, a: np.ndarray) -> np.ndarray:
        return np.zeros(len(a), np.uint8)

    def _cut(self, a: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(a), bool)
        cut[1:] = (a[1:] == 0x20) & (a[:-1] != 0x20)
        cut[starts] = True
        return np.flatnonzero(cut)

    def _pretoken_ids(self, words: list[bytes]) -> list[list[int]]:
        found = self.model.encode([x[1:].decode() for x in words], num_threads=1) if words else []
        return [[self.space] if len(x) == 1 else y for x, y in zip(words, found, strict=True)]

    _text_ids = _pretoken_ids

    def token_bytes(self) -> list[bytes]:
        """The bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
        return [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(self.pieces)]


def byte_level_bytes(encoder: Encoder) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary, by id (added tokens are their own strings)."""
    back = {c: i for i, c in _VISIBLE.items()}
    by_id: dict[int, bytes] = {}
    for text, i in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
        by_id[i] = bytes(back[c] for c in text)
    for i, token in encoder.tokenizer.get_added_tokens_decoder().items():
        by_id.setdefault(i, token.content.encode())
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]
