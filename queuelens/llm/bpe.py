"""Byte-pair encoding and decoding: speculate, then verify.

A word's tokens are proposed by greedy longest match. A row of tokens is what the merges would give exactly if every
two neighbours, merged from their own bytes, come out as these two again; so all neighbours of all proposed words are
tested at once against an array of pairs already judged. Only words with a failing pair run the merges one by one.
Texts are cut at blanks that can never lie inside a token; each distinct piece is encoded and decoded once while it is
in a worker's memory, which keeps the pieces of the last texts in two generations.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from queuelens.llm.common import kept_by_worker

TOKENIZER = "byte_bpe_50k.json"
#: Words of more bytes are merged with a heap; the rank of pairs that never merge; texts whose pieces are learnt at once.
LONG_WORD, NEVER, TOGETHER = 200, 1 << 30, 512
#: Words of up to so many bytes are merged together with others of their length.
TOGETHER_BYTES = 64
#: Pieces that one generation of a worker's memory holds (about 300 bytes each); there are two.
GENERATION = 200_000
#: A piece of Latin letters is one word for the pre-tokenizer, with the blank before it.
ONE_WORD = re.compile(" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: Such a word with marks behind it is two; an apostrophe could begin a contraction.
WORD_AND_MARKS = re.compile("(" + ONE_WORD.pattern + r")([!-&(-/:-@\[-`{-~]+)")
BEFORE_A_WORD = re.compile(r" (?=\S)")
Piece = tuple[bytes, str, bytes]


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in vocabulary files: printable bytes themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of one byte-level tokenizer file, and the pieces and pairs met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.letters = letters
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.decimal_of = [str(i) for i in range(len(self.bytes_of))]
        # lengths of the tokens that begin with four given bytes, the longest first
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) >= 4:
                lengths.setdefault(b[:4], set()).add(len(b))
        self.lengths = {start: sorted(found, reverse=True) for start, found in lengths.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(t) for t in (m.split(" ") if isinstance(m, str) else m))
            self.rank[self.ids[left], self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        # the same as arrays, for many words at once
        pairs = np.array([left << 32 | right for left, right in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = np.append(pairs[order], np.iinfo(np.int64).max), np.append(np.array(list(self.rank.values()))[order], NEVER)
        self.made_ids = np.append(np.array(self.made), 0)
        self.byte_ids = np.array([self.ids.get(bytes([b]), 0) for b in range(256)])
        tokenizer = Tokenizer.from_file(path)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.pieces: dict[str, Piece] = {}
        self.older: dict[str, Piece] = {}
        self.pairs = np.zeros(0, np.uint64)  # judged pairs, sorted; their lowest bit says whether they may stand together

    def merged(self, word: bytes) -> list[int]:
        """The tokens of ``word`` by merging: always the pair of the lowest rank, the leftmost first."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        if len(ids) > LONG_WORD:
            return self._merged_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two neighbours; NEVER where there is none (a missing neighbour is -1)."""
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], NEVER)

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """``merged`` of words of one length each, step by step for all: every step merges the best pair of each word."""
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        n = ids.shape[1]
        if n == 1:
            return ids.tolist()
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        left = np.full(len(words), n)
        going = np.arange(len(words))
        column = np.arange(n)
        while len(going):
            at = ranks[going].argmin(axis=1)
            low = ranks[going, at]
            more = low < NEVER
            going, at, low = going[more], at[more], low[more]
            if not len(going):
                break
            # the pair gives way to the token made of it, what follows moves up by one
            moved = np.minimum(column[None, :] + (column[None, :] > at[:, None]), n - 1)
            now = np.take_along_axis(ids[going], moved, axis=1)
            now[np.arange(len(going)), at] = self.made_ids[low]
            left[going] -= 1
            now[column[None, :] >= left[going][:, None]] = -1
            ids[going] = now
            known = np.take_along_axis(ranks[going], moved[:, :-1].clip(max=n - 2), axis=1)
            known[column[None, :-1] >= left[going][:, None] - 1] = NEVER
            rows = np.arange(len(going))
            before, after = np.maximum(at - 1, 0), np.minimum(at, n - 2)
            known[rows, after] = self._ranks(now[rows, after], now[rows, after + 1])
            has = at > 0
            known[rows[has], before[has]] = self._ranks(now[rows[has], before[has]], now[rows[has], at[has]])
            ranks[going] = known
        return [row[:k] for row, k in zip(ids.tolist(), left.tolist(), strict=True)]

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """``merged`` of each word: those of one length together, the few of rare lengths and long ones alone."""
        out: list[list[int]] = [[]] * len(words)
        of_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            of_size.setdefault(len(word), []).append(k)
        for size, ks in of_size.items():
            mine = [words[k] for k in ks]
            for k, ids in zip(ks, self.merged_together(mine) if len(ks) > 8 and size <= TOGETHER_BYTES else map(self.merged, mine), strict=True):
                out[k] = ids
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place), for words that are long."""
        get, made, n = self.rank.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(get(pair, NEVER), i, *pair) for i, pair in enumerate(zip(ids, ids[1:]))]
        heapq.heapify(heap)
        while heap:
            low, i, left, right = heapq.heappop(heap)
            if low == NEVER:
                break
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two is gone
            ids[i], ids[j], after[i] = made[low], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                heapq.heappush(heap, (get((ids[i], ids[after[i]]), NEVER), i, ids[i], ids[after[i]]))
            if before[i] >= 0:
                k = before[i]
                heapq.heappush(heap, (get((ids[k], ids[i]), NEVER), k, ids[k], ids[i]))
        return [x for x in ids if x >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, lengths, out, i, n = self.ids.get, self.lengths.get, [], 0, len(word)
        while i < n:
            for size in lengths(word[i:i + 4], ()):
                found = get(word[i:i + size]) if size <= n - i else None
                if found is not None:
                    break
            else:
                size = min(3, n - i)
                while (found := get(word[i:i + size])) is None:
                    size -= 1
            out.append(found)
            i += size
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair (left << 32 | right) stay apart; unknown pairs are judged by merging their bytes."""
        wanted = np.unique(pairs)
        at = np.searchsorted(self.pairs >> np.uint64(1), wanted)
        known = np.zeros(len(wanted), bool)
        inside = at < len(self.pairs)
        known[inside] = (self.pairs[at[inside]] >> np.uint64(1)) == wanted[inside]
        new = wanted[~known]
        if len(new):
            both = [(pair >> 31, pair & 0x7FFFFFFF) for pair in new.tolist()]
            made = self.merged_all([self.bytes_of[left] + self.bytes_of[right] for left, right in both])
            judged = [ids == [left, right] for ids, (left, right) in zip(made, both, strict=True)]
            self.pairs = np.sort(np.concatenate([self.pairs, (new << np.uint64(1)) | np.array(judged, np.uint64)]))
        at = np.searchsorted(self.pairs >> np.uint64(1), pairs)
        return (self.pairs[at] & np.uint64(1)).astype(bool)

    def encode_words(self, raw: list[bytes]) -> list[list[int]]:
        """Tokens of distinct words."""
        ids = [self.proposed(b) for b in raw]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(ids)), lengths)
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        if len(inner):
            apart = self.compatible((flat[inner] << np.uint64(31)) | flat[inner + 1])
            failing = np.unique(word_of[inner[~apart]]).tolist()
            for k, mine in zip(failing, self.merged_all([raw[k] for k in failing]), strict=True):
                ids[k] = mine
        return ids

    def _cut(self, piece: str) -> list[bytes | int]:
        """The words of a piece, and the ids of special tokens in it."""
        rest: list[str | int] = [piece]
        for token, i in self.special.items():
            if token in piece:
                rest = [y for x in rest for y in ([x] if isinstance(x, int) else [z for part in x.split(token) for z in (part, i)][:-1])]
        letters = self.letters
        return [y for x in rest for y in ([x] if isinstance(x, int) else [bytes([letters[c] for c in w]) for w, _ in self.split(x)] if x else [])]

    def learn(self, new: list[str]) -> None:
        """Encode and decode distinct pieces that are not in memory."""
        if len(self.pairs) > 4_000_000:
            self.pairs = np.zeros(0, np.uint64)
        pieces, older = self.pieces, self.older
        single, double, others = [], [], []
        for piece in new:
            if ONE_WORD.fullmatch(piece):
                single.append(piece)
            elif (found := WORD_AND_MARKS.fullmatch(piece)) and not any(t in piece for t in self.special):
                double.append((piece, *found.groups()))
            else:
                others.append(piece)
        halves = {half for _, *both in double for half in both}.difference(pieces, single)
        pieces.update((half, older[half]) for half in halves if half in older)
        single += halves.difference(older)
        cut = [self._cut(piece) for piece in others]
        words = list({w for c in cut for w in c if isinstance(w, bytes)})
        ids = self.encode_words([piece.encode() for piece in single] + words)
        known = dict(zip(words, ids[len(single):], strict=True))
        for piece, mine in zip(single, ids, strict=False):
            pieces[piece] = self._piece(mine)
        for piece, c in zip(others, cut, strict=True):
            pieces[piece] = self._piece([i for w in c for i in ([w] if isinstance(w, int) else known[w])])
        for piece, word, marks in double:
            a, b = pieces[word], pieces[marks]
            pieces[piece] = a[0] + b[0], f"{a[1]},{b[1]}", a[2] + b[2]

    def _piece(self, ids: list[int]) -> Piece:
        return array("i", ids).tobytes(), ",".join(map(self.decimal_of.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, bytes]]:
        """Ids of each whole text, the same as decimal numbers joined by commas, and the bytes they stand for."""
        for start in range(0, len(texts), TOGETHER):
            cut = [cut_at_blanks(text) for text in texts[start:start + TOGETHER]]
            wanted = set().union(*cut)
            if len(self.pieces) > GENERATION:
                self.older, self.pieces = self.pieces, {}
            new = wanted.difference(self.pieces)
            if new:
                # the set is looked through, not the memory, which is larger
                again = {piece for piece in new if piece in self.older}
                self.pieces.update((piece, self.older[piece]) for piece in again)
                self.learn(list(new - again))
            get = self.pieces.__getitem__
            for pieces in cut:
                ids, decimal, raw = zip(*map(get, pieces))
                if not decimal[0]:  # an empty piece can only be the first
                    decimal = decimal[1:]
                yield np.frombuffer(b"".join(ids), "<i4"), ",".join(decimal), b"".join(raw)

    def decode(self, ids: list[int]) -> str:
        """Text of a row of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def cut_at_blanks(text: str) -> list[str]:
    """``text`` in pieces, each beginning with a blank that starts a token.

    A blank between two characters that are no white space starts a token for certain. Where a piece would be empty
    or begin with white space, it stays with the piece before it.
    """
    first, *rest = BEFORE_A_WORD.split(text)
    return [first, *[" " + x for x in rest]]


def byte_pairs(path: str) -> BytePairs:
    """The encoder of a worker, whose memory serves later tasks as long as these are of this operator and file."""
    return kept_by_worker(("byte pairs", path), lambda: BytePairs(path))


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Pieces by the million make Python look for reference cycles over and over; there are none among them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _rows(path: str, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_pairs(path)
        for rows in batches:
            out = []
            with no_cycle_search():
                for ids, decimal, raw in encoder.encode(rows["_text"].fillna("").tolist()):
                    decoded = raw.decode("utf-8", "replace").encode()
                    out.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            made.insert(0, key, rows["_key"].to_numpy())
            yield made

    return run


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Columns: key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256. Null and empty texts give 0
    tokens and the digests of nothing. Null keys and repeated rows are kept as they are, other columns are not
    read. One row is encoded at a time, so a very long text needs memory for itself and its ids only.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(
        _rows(path, key), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_pairs(path)
        for rows in batches:
            yield rows.assign(ids=[ids for ids, _, _ in encoder.encode(rows.pop("_text").fillna("").tolist())])

    return run


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every whole text; null counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInPandas(
        _ids(path or public_tokenizers.path(TOKENIZER)), f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); null ids give null."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_pairs(path)
        for rows in batches:
            yield rows.assign(text=[None if x is None else encoder.decode(list(x)) for x in rows.pop("_ids")])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(F.col(key), F.col(ids).alias("_ids")).mapInPandas(run, f"`{key}` {kind}, text string")
