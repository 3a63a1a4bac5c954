"""Token ids in files, packed by an adaptive range coder.

An id is coded in one step. A flag says whether it is what the last two ids (order 2) or the last one (order 1)
predict, or neither; its probability mixes what has been seen at this confidence of either prediction, weighted by
which of the two was right more often. Any other id follows within the flag's interval under adaptive order-0
frequencies, which are worked out anew after 1, 2, 4, 8 ... ids of every stream. All models start anew with every block.

A block is dealt over up to ``STREAMS`` streams of neighbouring ids, and one array operation codes a step of all
streams. They learn into the same models, so that a stream may be short; each carries its number of ids and a checksum.
All arithmetic is on whole numbers, so that any machine decodes what another has coded.

The files are Parquet tables with a row per frame: documents in ascending order of id, their lengths, and the
packed block of all their ids.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from queuelens.llm.common import MEMO_WORDS, kept_by_worker
from queuelens.session import scratch_path

TOKENIZER, END = "word_bpe_49k.json", 2
#: Ids of a frame, whose ids are one block; the most streams of a block and the fewest ids of a stream.
FRAME, STREAMS, SHORTEST = 1 << 21, 2048, 512
#: Ids that can be coded, and one that stands for no prediction.
IDS, NO_ID = 1 << 16, (1 << 17) - 1
#: Cells predicted from by two ids, parts of a flag's and an id's share; the coder's words and the limits of its interval.
SLOT_BITS, FLAG_BITS, ID_BITS = 18, 12, 20
WORD, ID_SHIFT, ONE, LOW_RANGE, FULL = np.uint64(32), np.uint64(ID_BITS), np.uint64(1), np.uint64(1 << 32), np.uint64((1 << 64) - 1)
#: How sure a prediction can be, and the state of a cell without one.
SURE, EMPTY, STATES = 7, 8, 9
#: The normalizer and the pre-tokenizer of ``TOKENIZER``.
RULES = [{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
         {"type": "Sequence", "pretokenizers": [
             {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
#: Words of these letters are in the tokenizer's normal form and one piece to it; its model takes a byte as a letter.
LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
BYTE_LETTERS = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
#: Bytes of texts that are cut into pieces together.
TOGETHER = 16 << 20
#: Marks that the tokenizer cuts off behind a letter (not the apostrophe), and how many runs of them a task remembers.
MARKS, MEMO_MARKS = b'.,;:!?#%&*$|<>()"-', 10_000


class Model:
    """Predictions and frequencies of a block; ``n`` in the methods says how many of the first streams are still going."""

    def __init__(self, streams: int):
        # cells hold a predicted id and how sure it is: id << 4 | state
        self.cells = [np.full(1 << s, NO_ID << 4 | EMPTY, np.int32) for s in (16, SLOT_BITS)]
        self.last = np.zeros((2, streams), np.int64)
        start = np.array([[1 + 2 * k, 1, 6] for k in range(EMPTY)] + [[1, 1, 400]], np.int64)
        self.start = start[:, (1, 0, 2)], start
        self.tally, self.fresh = np.zeros((2, STATES * STATES * 3), np.int64)
        self.wins = np.ones((2, STATES, STATES), np.int64)
        self.counts = np.zeros(IDS, np.int64)
        self.flags_from_tally()
        self.ids_from_counts()

    def flags_from_tally(self) -> None:
        """``flag_start`` and ``flag_size`` by state of order 1, state of order 2 and flag: both orders' shares, mixed."""
        seen = self.tally.reshape(STATES, STATES, 3)
        by_one, by_two = self.start[0] + 2 * seen.sum(axis=1), self.start[1] + 2 * seen.sum(axis=0)
        one, two = ((r << FLAG_BITS) // r.sum(axis=1, keepdims=True) for r in (by_one, by_two))
        one, two = one[:, None], two[None]
        fresh = self.fresh.reshape(seen.shape)
        self.wins += np.stack([(fresh * (one > two)).sum(axis=2), (fresh * (two > one)).sum(axis=2)])
        self.fresh[:] = 0
        weight = ((self.wins[1] << 8) // self.wins.sum(axis=0))[:, :, None]
        mix = ((two * weight + one * (256 - weight)) >> 8) + 1
        size = 1 + mix * ((1 << FLAG_BITS) - 3) // mix.sum(axis=2, keepdims=True)
        size[:, :, 2] = (1 << FLAG_BITS) - size[:, :, 0] - size[:, :, 1]
        self.flag_start = (size.cumsum(axis=2) - size).ravel().astype(np.uint64)
        self.flag_size = size.ravel().astype(np.uint64)

    def ids_from_counts(self) -> None:
        """``id_start`` and ``id_size`` of order 0; the entry behind the last id stands for one that needs no more telling."""
        whole, known = 1 << ID_BITS, int(self.counts.sum())
        size = np.full(IDS, whole // IDS) if not known else 1 + self.counts * (whole - IDS) // known
        size[size.argmax()] += whole - size.sum()
        self.sizes = size
        self.id_start = np.append(size.cumsum() - size, 0).astype(np.uint64)
        self.id_size = np.append(size, whole).astype(np.uint64)

    def predictions(self, n: int) -> None:
        one, two = self.last[0, :n], self.last[1, :n]
        self.at = one, (one * 0x85EBCA6B + two * 0xC2B2AE35) >> 9 & (1 << SLOT_BITS) - 1
        self.now = [c.take(a) for c, a in zip(self.cells, self.at, strict=True)]
        self.guess = [c >> 4 for c in self.now]
        self.state = [c & 15 for c in self.now]
        self.row = (self.state[0] * STATES + self.state[1]) * 3

    def interval(self, ids: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.row + flag
        k = np.where(flag == 2, ids, IDS)
        size = self.flag_size.take(at)
        return (self.flag_start.take(at) << ID_SHIFT) + size * self.id_start.take(k), size * self.id_size.take(k)

    def learn(self, n: int, ids: np.ndarray, flag: np.ndarray) -> None:
        self.fresh += np.bincount(self.row + flag, minlength=len(self.fresh))
        told = (ids << 4).astype(np.int32)
        for cells, at, now, guess, state in zip(self.cells, self.at, self.now, self.guess, self.state, strict=True):
            # an unsure or empty cell (0 or 8) takes the id, a wrong one loses half of its sureness
            wrong = np.where(state & 7 == 0, told, now - (state + 1 >> 1))
            cells[at] = np.where(guess == ids, now + (state < SURE), wrong)
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids

    def count(self, grid: np.ndarray, t: int) -> bool:
        """After ``t`` ids of every stream; true where order 0 has changed, which it does at powers of 2."""
        if t < 16 or t % 16 == 0:
            self.tally += self.fresh
            self.flags_from_tally()
        if t & (t - 1):
            return False
        self.counts += np.bincount(grid[t >> 1:t].ravel(), minlength=IDS)
        self.ids_from_counts()
        return True


def _lengths(n: int) -> np.ndarray:
    """Ids of each stream: up to STREAMS of them of SHORTEST ids or more, all but the last alike."""
    each = max(SHORTEST, -(-n // STREAMS))
    lengths = np.full(-(-n // each), each)
    lengths[-1] = n - each * (len(lengths) - 1)
    return lengths


def pack(ids: np.ndarray) -> bytes:
    """A block: number of streams, then for each its ids, words and checksum, then the words of all."""
    if not len(ids):
        return np.zeros(1, "<u4").tobytes()
    if ids.min() < 0 or ids.max() >= IDS:
        raise ValueError("ids must be below 65536")
    lengths = _lengths(len(ids))
    streams, each = len(lengths), int(lengths[0])
    rows = np.zeros((streams, each), np.int64)
    rows.ravel()[:len(ids)] = ids
    grid = np.ascontiguousarray(rows.T)
    model = Model(streams)
    low, width = np.zeros(streams, np.uint64), np.full(streams, FULL, np.uint64)
    out, used = np.zeros((streams, each + 2), np.uint64), np.zeros(streams, np.int64)
    for t in range(each):
        n = streams - int(t >= lengths[-1])
        now = grid[t, :n]
        model.predictions(n)
        flag = np.where(now == model.guess[1], 0, 2 - (now == model.guess[0]))
        start, size = model.interval(now, flag)
        part = width[:n] >> WORD
        at, wide = low[:n] + part * start, part * size
        carry = np.flatnonzero(at < low[:n])
        if len(carry):
            out[carry, used[carry] - 1] += ONE
        small = np.flatnonzero(wide < LOW_RANGE)
        if len(small):
            out[small, used[small]] = at[small] >> WORD
            used[small] += 1
            at[small] <<= WORD
            wide[small] <<= WORD
        low[:n], width[:n] = at, wide
        model.learn(n, now, flag)
        model.count(grid[:, :n], t + 1)
    # one word ends a stream: the next multiple of its range lies in every interval, and what follows reads as 0
    last = low + (LOW_RANGE - ONE)
    carry = np.flatnonzero(last < low)
    out[carry, used[carry] - 1] += ONE
    out[np.arange(streams), used] = last >> WORD
    used += 1
    while len((over := np.nonzero(out >= LOW_RANGE))[0]):  # carries run to the front
        out[over] -= LOW_RANGE
        out[over[0], over[1] - 1] += ONE
    words = out.astype("<u4")
    sums = [zlib.crc32(rows[i, :n].astype("<u4").tobytes()) for i, n in enumerate(lengths.tolist())]
    head = np.stack([lengths, used, np.array(sums)], axis=1).astype("<u4")
    return np.array([streams], "<u4").tobytes() + head.tobytes() + words[np.arange(words.shape[1]) < used[:, None]].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The ids of a block; ValueError where a stream's checksum does not hold."""
    streams = int(np.frombuffer(packed, "<u4", 1)[0])
    if not streams:
        return np.zeros(0, np.int64)
    lengths, sizes, sums = np.frombuffer(packed, "<u4", 3 * streams, 4).reshape(streams, 3).astype(np.int64).T
    words = np.zeros((streams, int(sizes.max()) + 2), np.uint64)
    words[np.arange(words.shape[1]) < sizes[:, None]] = np.frombuffer(packed, "<u4", int(sizes.sum()), 4 + 12 * streams)
    each = int(lengths[0])
    grid = np.zeros((each, streams), np.int64)
    model = Model(streams)
    told = np.repeat(np.arange(IDS, dtype=np.int32), model.sizes)
    code = (words[:, 0] << WORD) | words[:, 1]
    used, width = np.full(streams, 2), np.full(streams, FULL, np.uint64)
    for t in range(each):
        n = streams - int(t >= lengths[-1])
        model.predictions(n)
        part = width[:n] >> WORD
        value = np.minimum(code[:n] // part, LOW_RANGE - ONE)
        high = value >> ID_SHIFT
        flag = (high >= model.flag_start.take(model.row + 1)).astype(np.int64) + (high >= model.flag_start.take(model.row + 2))
        at = model.row + flag
        other = told.take(((value - (model.flag_start.take(at) << ID_SHIFT)) // model.flag_size.take(at)).astype(np.int64))
        now = np.where(flag == 2, other, np.where(flag == 1, model.guess[0], model.guess[1]) & (IDS - 1))  # damaged words may ask for an empty cell
        start, size = model.interval(now, flag)
        rest, wide = code[:n] - part * start, part * size
        small = np.flatnonzero(wide < LOW_RANGE)
        if len(small):
            rest[small] = (rest[small] << WORD) | words[small, np.minimum(used[small], words.shape[1] - 1)]
            used[small] += 1
            wide[small] <<= WORD
        code[:n], width[:n] = rest, wide
        grid[t, :n] = now
        model.learn(n, now, flag)
        if model.count(grid[:, :n], t + 1):
            told = np.repeat(np.arange(IDS, dtype=np.int32), model.sizes)
    rows = np.ascontiguousarray(grid.T)
    for i, (n, s) in enumerate(zip(lengths.tolist(), sums.tolist(), strict=True)):
        if zlib.crc32(rows[i, :n].astype("<u4").tobytes()) != s:
            raise ValueError(f"stream {i} is damaged")
    return rows.ravel()[:int(lengths.sum())]


def as_bytes(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


class TextIds:
    """Ids of whole texts by the tokenizers library, which is asked once for each piece between white space.

    Texts are cut into pieces some megabytes at a time, and every distinct piece of these is looked up once.

    The tokenizer drops white space before any merge, so the ids of a text are those of its pieces in a row. Under
    ``RULES`` it lowers all letters, so A-Z are lowered before pieces are told apart, but not where a special token may
    be written. A piece of Latin letters alone, with marks behind them or not, is split before the marks by these rules
    too: its letters are merged by the library's model, once for all pieces with the same letters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.latin = all(s is not None for s in steps) and [json.loads(s.__getstate__()) for s in steps] == RULES
        self.known = Pieces(self.encoded)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def encoded(self, piece: bytes) -> bytes:
        ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_marks(self, marks: bytes) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= MEMO_MARKS:
                self.marks.clear()
            self.marks[marks] = self.encoded(marks)
        return self.marks[marks]

    def of_word(self, word: bytes) -> bytes:
        """Of letters alone; remembered."""
        ids = self.older.get(word)
        if ids is None:
            letters = word.decode()
            merged = self.model.tokenize(letters if word.isascii() else letters.translate(BYTE_LETTERS))
            ids = struct.pack(f"<{len(merged)}I", *[x.id for x in merged])
        if len(self.words) >= MEMO_WORDS:
            self.older, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def of_pieces(self, pieces: pa.Array) -> list[bytes]:
        """Of distinct pieces, whose distinct words are looked up once each."""
        if not self.latin:
            return list(map(self.known.__getitem__, as_bytes(pieces)))
        coded = pc.ascii_rtrim(pieces, characters=MARKS.decode()).dictionary_encode()
        words = as_bytes(coded.dictionary)
        plain = pc.match_substring_regex(coded.dictionary, LETTERS).to_numpy(zero_copy_only=False)
        found = list(map(self.words.get, words))
        for k in np.flatnonzero(plain).tolist():
            if found[k] is None:
                found[k] = self.of_word(words[k])
        at = coded.indices.to_numpy()
        ids = np.array(found, object).take(at).tolist()
        longer = pc.binary_length(pieces).to_numpy() - pc.binary_length(coded.dictionary).to_numpy().take(at)
        rest = np.flatnonzero((longer > 0) | ~plain.take(at))
        for k, piece, marks in zip(rest.tolist(), as_bytes(pieces.take(pa.array(rest))), longer.take(rest).tolist(), strict=True):
            ids[k] = self.known[piece] if ids[k] is None else ids[k] + self.of_marks(piece[len(piece) - marks:])
        return ids

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text.encode().lower() if self.latin and "<|" not in text else text.encode())
            size += len(group[-1])
            if size >= TOGETHER:
                yield from self.of_group(group)
                group, size = [], 0
        if group:
            yield from self.of_group(group)

    def of_group(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; a piece is looked up once for all of them. These are fewer than 2^31 bytes or one text."""
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        pieces = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = pieces.flatten().dictionary_encode()
        parts = self.of_pieces(coded.dictionary)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        starts = sizes.cumsum() - sizes
        at = coded.indices.to_numpy()
        counts = sizes.take(at)
        ends = counts.cumsum()
        # the place of every id among those of the distinct pieces
        places = np.repeat((starts.take(at) - (ends - counts)).astype(np.int32), counts)
        places += np.arange(len(places), dtype=np.int32)
        ids = np.frombuffer(b"".join(parts), "<u4").take(places)
        return np.split(ids, np.append(0, ends).take(pieces.offsets.to_numpy()[1:-1]))


class Pieces(dict):
    """Remembers what ``ids_of`` says of a piece."""

    def __init__(self, ids_of: Callable[[bytes], bytes]):
        self.ids_of = ids_of

    def __missing__(self, piece: bytes) -> bytes:
        ids = self[piece] = self.ids_of(piece)
        return ids


def _text_ids(path: str, changed: int) -> TextIds:
    """Kept by a worker from task to task, until the file changes or the worker turns to another operator."""
    return kept_by_worker(("text ids", path, changed), lambda: TextIds(path))


def _framed(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = _text_ids(path, os.stat(path).st_mtime_ns)
        docs: list = []
        held: list[np.ndarray] = []
        size = frame = 0
        end = np.array([END], "<u4")

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"frame": [frame], "doc_ids": [docs], "lengths": [[len(x) for x in held]], "n_tokens": [size],
                                 "blocks": [pack(np.concatenate(held).astype(np.int64))]})

        for rows in batches:
            for doc, ids in zip(rows["doc"].tolist(), ids_of(rows["text"].fillna("").tolist()), strict=True):
                docs.append(None if pd.isna(doc) else int(doc))
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= FRAME:
                    yield closed()
                    docs, held, size, frame = [], [], 0, frame + 1
        if docs:
            yield closed()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> None:
    """Write the ids of every whole text, each followed by END, in ascending order of the id.

    Null texts count as empty; null keys come first; equal keys are ordered by text. Keys must be whole numbers; other
    columns are not read. A frame holds whole documents, so memory is bounded by FRAME ids plus the longest text.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    order = [F.col("doc").asc_nulls_first(), F.coalesce("text", F.lit("")).asc()]
    framed = rows.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInPandas(
        _framed(tokenizer), "frame long, doc_ids array<long>, lengths array<long>, n_tokens long, blocks binary")
    framed.withColumn("part", F.spark_partition_id()).write.parquet(path)


def _unframed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for part, frame, docs, lengths, packed in zip(rows["part"], rows["frame"], rows["doc_ids"], rows["lengths"], rows["blocks"], strict=True):
            ids = unpack(packed).astype("<u4")
            ends = np.cumsum(np.array(lengths, np.int64))
            yield pd.DataFrame({"doc": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"), "part": part, "frame": frame, "offset": ends - lengths,
                                "ids": [x for x in np.split(ids, ends[:-1])]})


def _with_starts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the number of ids before each document: sums over the written parts, then over a part's frames."""
    first = W.unboundedPreceding
    sizes = files.select(F.col("part").alias("_part"), F.col("frame").alias("_frame"), "n_tokens")
    whole = sizes.groupBy("_part").agg(F.sum("n_tokens").alias("n"))  # one row per written part
    before = whole.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(first, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("_part").orderBy("_frame").rowsBetween(first, -1)), F.lit(0))
    starts = sizes.select("_part", "_frame", inner.alias("_inner")).join(before, "_part")
    return rows.join(starts, (F.col("part") == F.col("_part")) & (F.col("frame") == F.col("_frame"))).withColumn(
        "start", F.col("offset") + F.col("_inner") + F.col("_before"))


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): ``start`` is the number of ids before the document in the order of the files."""
    files = spark.read.parquet(path)
    rows = files.mapInPandas(_unframed, "doc long, part int, frame long, offset long, ids array<long>")
    return _with_starts(files, rows).select(F.col("doc").alias(key), "start", "ids")


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _unframed(batches):
        ids = rows.pop("ids")
        yield rows.assign(n_tokens=[len(x) for x in ids], ids_crc32=[zlib.crc32(x.tobytes()) for x in ids])


def round_trip(docs: DataFrame, spark: SparkSession, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write token files to the shared folder, read them back: (key, start, n_tokens, ids_crc32).

    The checksum is taken over the ids as little-endian unsigned 32-bit numbers, the end id included. An empty
    table gives an empty result.
    """
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, text, key)
    files = spark.read.parquet(path)
    rows = files.mapInPandas(_digested, "doc long, part int, frame long, offset long, n_tokens long, ids_crc32 long")
    return _with_starts(files, rows).select(F.col("doc").alias(key), "start", "n_tokens", "ids_crc32")
