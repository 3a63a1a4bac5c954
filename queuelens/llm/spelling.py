"""Grouping spelling variants: words one edit apart, found through K-d trees over their letter counts.

Words of one length share a tree whose boxes hold a bounded number of words; a box is the work of one task. Every
word is sent to the boxes of its own length and of the length below that one edit can reach. There a second tree of
the same kind narrows the search to pairs of letter-count vectors one edit apart, and the order of letters settles
which words of such a pair are near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.kdtree import LETTERS, PLACE, Tree, build, points, reach
from queuelens.session import cut_lineage

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The upper trees are cut along this many words drawn in an order of hashes. Which words these are decides only how even
#: the boxes are: a box that turns out larger is dealt over several tasks, and every word takes part in the search.
TREE_WORDS = 65_536
BOX_WORDS = 16_384
BUCKET = 32
KEYS_AT_ONCE = 2_000_000
WORD_ROWS = 65_536

_random = np.random.default_rng(20240229)
LETTER_KEY = _random.integers(1, 1 << 63, len(LETTERS), dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PAIR_KEY = np.uint64(0xD6E8FEB86659FD93)


def planted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, least: int = 7) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, counted over all whole texts, with a letter missing in some.

    Where ``every`` divides the crc32 of ``<id>:<run>``, the run's letter at crc32 modulo its length is left out.
    Words of fewer than ``least`` letters and those that occur once are left out. A null id counts as empty.
    """
    lowered = F.translate(F.col(text), CAPITALS, SMALL)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        lowered, F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= least)
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    word = F.when(h % every == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))


def _letters(column: pa.Array) -> np.ndarray:
    """One row of letters a word, for words of one length."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(n, -1) if n else np.zeros((0, 0), dtype=np.uint8)


def upper_trees(words: DataFrame) -> dict[int, tuple[Tree, int]]:
    """For each length the tree over its words, and the number of its first box (boxes are numbered throughout).

    ``TREE_WORDS`` words at most reach the driver, whatever the number of documents. Boxes are cut for
    ``BOX_WORDS`` words each, or for 1 / ``TREE_WORDS`` of all words where that is more.
    """
    sizes = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    drawn = (words.filter(F.pmod(F.xxhash64("letters"), F.lit(max(1, total))) < TREE_WORDS).select("size", "letters")
             .limit(2 * TREE_WORDS).collect())
    of_size: dict[int, list[bytes]] = {s: [] for s in sizes}
    for row in drawn:
        of_size[row["size"]].append(bytes(row["letters"]))
    trees, first = {}, 0
    for size in sorted(sizes):
        letters = np.frombuffer(b"".join(sorted(of_size[size])), dtype=np.uint8).reshape(-1, size)
        share = sizes[size] / max(1, len(letters))
        tree, _ = build(points(letters), np.full(len(letters), share), max(BOX_WORDS, total / TREE_WORDS))
        trees[size] = (tree, first)
        first += max(1, tree.boxes)
    return trees


def _copies(trees: dict[int, tuple[Tree, int]]):
    """Each word into its own box (role 0) and into every box that one edit can reach (role 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("letters")).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                mine = batch.take(pa.array(np.flatnonzero(lengths == size)))
                letters = mine.column("letters")
                x = points(_letters(letters))
                found = []
                if size in trees:
                    tree, first = trees[size]
                    rows, boxes = reach(tree, x, True)
                    found.append((1, rows, boxes + first))
                    home = _home(tree, x)
                    found.append((0, np.arange(len(x)), home + first))
                if size - 1 in trees:
                    tree, first = trees[size - 1]
                    rows, boxes = reach(tree, x, False)
                    found.append((1, rows, boxes + first))
                for role, rows, boxes in found:
                    for start in range(0, len(rows), WORD_ROWS):
                        take = pa.array(rows[start:start + WORD_ROWS])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(boxes[start:start + WORD_ROWS]), pa.array(np.full(len(take), role, dtype=np.int32)),
                             letters.take(take), mine.column("n").take(take)], ["box", "role", "letters", "n"])

    return run


def _home(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    while (inner := tree.letter[node] >= 0).any():
        at = np.flatnonzero(inner)
        here = node[at]
        low = x[at, tree.letter[here]] <= tree.upto[here]
        node[at] = np.where(low, tree.left[here], tree.right[here])
    return tree.left[node]


class _Words:
    """Words of one length, gathered by letter-count vector."""

    def __init__(self, letters: np.ndarray, n: np.ndarray):
        vectors = np.sort(letters, axis=1)
        order = np.lexsort(vectors.T[::-1]) if len(letters) else np.zeros(0, dtype=np.int64)
        self.letters, self.n = letters[order], n[order]
        vectors = vectors[order]
        new = np.ones(len(order), dtype=bool)
        if len(order) > 1:
            new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.vector = np.cumsum(new) - 1
        self.x = points(vectors[new])
        place = PLACE[self.letters]
        size = letters.shape[1]
        key = LETTER_KEY[place]
        powers = np.multiply.accumulate(np.full(size, STEP)) if size else np.zeros(0, dtype=np.uint64)
        self.parts = key * powers
        self.whole = self.parts.sum(axis=1, dtype=np.uint64)
        # where each letter of each vector stands: ranges of (word, place in the word)
        slots = (self.vector[:, None] * 256 + place).ravel()
        self.slot_order = np.argsort(slots, kind="stable")
        self.slots = slots[self.slot_order]

    def places(self, vector: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, word, position) of the given letter in all words of the given vector, for each pair."""
        wanted = vector * 256 + letter
        low, high = np.searchsorted(self.slots, wanted), np.searchsorted(self.slots, wanted, side="right")
        pair, at = _ranges(low, high)
        flat = self.slot_order[at]
        return pair, flat // self.letters.shape[1], flat % self.letters.shape[1]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, value) for every value of ``low[i] <= value < high[i]``."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


#: By how much the sums of letter keys of two vectors differ: raised letter minus lowered, and a dropped letter.
_LETTER = np.arange(len(LETTERS))
_RAISED, _LOWERED = (a.ravel() for a in np.meshgrid(_LETTER, _LETTER, indexing="ij"))
_RAISED, _LOWERED = _RAISED[(keep := _RAISED < _LOWERED)], _LOWERED[keep]
_REPLACED = LETTER_KEY[_RAISED] - LETTER_KEY[_LOWERED]
_BY_REPLACED, _BY_DROPPED = np.argsort(_REPLACED), np.argsort(np.uint64(0) - LETTER_KEY)


def _vector_pairs(home: _Words, tree: Tree, bucket: np.ndarray, guests: _Words, replaced: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(guest vector, home vector, raised letter or -1, lowered letter) of vectors one edit apart, in portions."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(tree.boxes + 1))
    sums = lambda w: (w.x.astype(np.uint64) * LETTER_KEY).sum(axis=1, dtype=np.uint64)
    home_sums, guest_sums = sums(home), sums(guests)
    table = _REPLACED[_BY_REPLACED] if replaced else (np.uint64(0) - LETTER_KEY)[_BY_DROPPED]
    rows, boxes = reach(tree, guests.x, replaced)
    step = max(1, KEYS_AT_ONCE // BUCKET)
    for start in range(0, len(rows), step):
        g, b = rows[start:start + step], boxes[start:start + step]
        owner, at = _ranges(edges[b], edges[b + 1])
        g, h = g[owner], order[at]
        apart = home_sums[h] - guest_sums[g]
        at = np.minimum(np.searchsorted(table, apart), len(table) - 1)
        hit = table[at] == apart
        g, h, which = g[hit], h[hit], (_BY_REPLACED if replaced else _BY_DROPPED)[at[hit]]
        raised = _RAISED[which] if replaced else np.full(len(which), -1)
        lowered = _LOWERED[which] if replaced else which
        yield g, h, raised, lowered


def _near_words(home: _Words, guests: _Words, g: np.ndarray, h: np.ndarray, raised: np.ndarray, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(guest word, home word) one edit apart, of pairs of vectors one edit apart."""
    size = home.letters.shape[1]
    pair, word, at = guests.places(g, lowered)
    if len(raised) and raised[0] >= 0:  # blank the letter that differs on both sides
        keys = guests.whole[word] - guests.parts[word, at]
        pair2, word2, at2 = home.places(h, raised)
        keys2 = home.whole[word2] - home.parts[word2, at2]
    else:  # drop it from the longer word; of equal letters in a row the first stands for all
        first = (at == 0) | (guests.letters[word, np.maximum(at - 1, 0)] != guests.letters[word, at])
        pair, word, at = pair[first], word[first], at[first]
        before = np.concatenate([np.zeros((len(guests.parts), 1), dtype=np.uint64), np.cumsum(guests.parts, axis=1, dtype=np.uint64)], axis=1)
        keys = before[word, at] + (guests.whole[word] - before[word, at + 1]) * STEP_BACK
        spans = np.searchsorted(home.vector, h), np.searchsorted(home.vector, h, side="right")
        pair2, word2 = _ranges(*spans)
        keys2 = home.whole[word2]
    keys, keys2 = keys + pair.astype(np.uint64) * PAIR_KEY, keys2 + pair2.astype(np.uint64) * PAIR_KEY
    order = np.argsort(keys2)
    keys2 = keys2[order]
    i, j = _ranges(np.searchsorted(keys2, keys), np.searchsorted(keys2, keys, side="right"))
    u, v = word[i], word2[order[j]]
    a, b = guests.letters[u], home.letters[v]
    if a.shape[1] == size:
        sure = (a != b).sum(axis=1) == 1
    else:
        ahead = np.logical_and.accumulate(a[:, :size] == b, axis=1).sum(axis=1)
        behind = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
        sure = ahead + behind >= size
    return u[sure], v[sure]


def _portions(weights: np.ndarray) -> Iterator[slice]:
    """Stretches of about ``KEYS_AT_ONCE``."""
    part = np.cumsum(weights) // KEYS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(weights)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _edges(home: _Words, tree: Tree, bucket: np.ndarray, guests: _Words) -> pa.RecordBatch | None:
    """For each word with a near one here: how many, and the most frequent (of equals the smallest)."""
    replaced = guests.letters.shape[1] == home.letters.shape[1]
    us, vs = [], []
    held, invited = np.bincount(home.vector), np.bincount(guests.vector)
    for g, h, raised, lowered in _vector_pairs(home, tree, bucket, guests, replaced):
        for part in _portions(invited[g] + held[h]):
            u, v = _near_words(home, guests, g[part], h[part], raised[part], lowered[part])
            us.append(u)
            vs.append(v)
    if not us or not sum(map(len, us)):
        return None
    u, v = np.concatenate(us), np.concatenate(vs)
    out = []
    for mine, mine_at, other, other_at in ((guests, u, home, v), (home, v, guests, u)):
        # smallest in code-point order among equals: Latin-1 bytes sort like code points
        rank = np.empty(len(other.letters), dtype=np.int64)
        rank[np.lexsort(other.letters.T[::-1])] = np.arange(len(rank))
        order = np.lexsort((rank[other_at], -other.n[other_at], mine_at))
        mine_at, other_at = mine_at[order], other_at[order]
        first = np.flatnonzero(np.r_[True, mine_at[1:] != mine_at[:-1]])
        counts = np.diff(np.r_[first, len(mine_at)])
        text = lambda w, i: pa.array([bytes(r) for r in w.letters[i]], pa.binary())
        out.append(pa.RecordBatch.from_arrays([text(mine, mine_at[first]), pa.array(counts.astype(np.int64)), pa.array(other.n[other_at[first]]),
                                               text(other, other_at[first])], ["letters", "n_near", "best_n", "best"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by box, part and role: the box's own words come first and are kept, guests stream past them."""
    where, waiting, home, tree, bucket = None, [], None, None, None

    def settle() -> None:
        nonlocal home, tree, bucket, waiting
        letters = np.vstack([_letters(b.column("letters")) for b in waiting])
        home = _Words(letters, np.concatenate([b.column("n").to_numpy() for b in waiting]))
        tree, bucket = build(home.x, np.ones(len(home.x)), BUCKET)
        waiting = []

    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in ("box", "part", "role")], axis=1)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
        for start, end in zip(cuts, cuts[1:]):
            if end == start:
                continue
            box, part, role = place[start].tolist()
            rows = batch.slice(start, end - start)
            if (box, part) != where:
                where, waiting, home = (box, part), [], None
            if role == 0:
                waiting.append(rows)
                continue
            if waiting:
                settle()
            if home is None:
                continue  # guests of a part of a box that holds no word
            lengths = pa.compute.binary_length(rows.column("letters")).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                some = rows.take(pa.array(np.flatnonzero(lengths == size)))
                made = _edges(home, tree, bucket, _Words(_letters(some.column("letters")), some.column("n").to_numpy()))
                if made is not None:
                    yield made


def near_words(words: DataFrame) -> DataFrame:
    """(letters, n_near, best): for each word with near ones how many they are, and the one of largest ``n``."""
    trees = upper_trees(words)
    copies = cut_lineage(words.select("letters", "n").mapInArrow(_copies(trees), "box bigint, role int, letters binary, n bigint"))
    # a box that holds more words than meant is dealt over parts, and its guests go to all of them
    held = copies.filter("role = 0").groupBy("box").agg(F.count(F.lit(1)).alias("held"))
    parts = held.select("box", F.ceil(F.col("held") / (4 * BOX_WORDS)).cast("int").alias("parts")).filter("parts > 1")
    dealt = copies.join(F.broadcast(parts), "box", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("letters"), F.col("parts")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("parts") - 1))
    spread = dealt.select("box", F.explode(part).alias("part"), "role", "letters", "n")
    found = (spread.repartition("box", "part").sortWithinPartitions("box", "part", "role")
             .mapInArrow(_search, "letters binary, n_near bigint, best_n bigint, best binary"))
    return found.groupBy("letters").agg(F.sum("n_near").alias("n_near"), F.min_by("best", F.struct(-F.col("best_n"), F.col("best"))).alias("best"),
                                        F.max("best_n").alias("best_n"))


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n).

    Two words are near if one inserted, deleted or replaced letter turns one into the other. A word's form is its
    near word of largest n (of equals the smallest), if that n is ``factor`` times its own or more; its root is the
    end of that chain. As n grows by the factor with each step, chains are short and their length is known from n.
    """
    words = cut_lineage(words.select("word", "n", F.length("word").alias("size"), F.encode("word", "ISO-8859-1").alias("letters")))
    text = lambda c: F.decode(c, "ISO-8859-1")
    near = near_words(words)
    formed = F.col("best_n") >= factor * F.col("n")
    rows = cut_lineage(words.join(near, "letters", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, text(F.col("best"))).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n")))
    steps = rows.agg(F.max(F.log10(F.col("n") / 2.0))).first()[0] or 0.0
    steps = int(steps / np.log10(factor) + 1e-9) if factor > 1 else 64
    jumps = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    reach_now = 1
    while reach_now < steps:  # each turn doubles how far a jump goes
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = cut_lineage(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach_now *= 2
    return rows.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = 10) -> DataFrame:
    """Variants among the words of ``planted_words``: one row a word, as ``group_variants`` returns them.

    Null and empty texts have no words, and an empty table gives an empty result. Repeated rows count as often as
    they occur. A run of letters of any length is a word; its cost grows with its length, and its pairs are compared
    with words of its own length and the next only. Columns other than ``key`` and ``text`` are not read.
    """
    return group_variants(planted_words(docs, key, text), factor)
