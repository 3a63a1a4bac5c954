"""Near-duplicates by an inverted join on MinHash coordinates.

Texts are sets of word shingles; equal sets form a class, and one text stands for each class. Its signature has
``COORDINATES`` minima, and the text is posted under each coordinate with its value. Of these lists those with one
text are skipped. The others are put in order by their length, rarest first: two signatures that agree in at least
``MATCHES`` places must then meet in one of the first ``COORDINATES - MATCHES + 1`` lists of both, so only this prefix
is joined, and a passage that very many texts share, whose lists are the longest, never brings them together.
Collisions in the joined lists are counted for each pair; the long lists left out are merged in by comparing the two
signatures, and pairs with enough matches are confirmed on their full sets.

Lists are joined so that a group of copies never spreads into all its pairs. Every text of a list is held against the
list's most central text, the one whose lists are longest altogether: in a group of edited copies that is the text
they were made from. Lists whose texts are thereby one component are done. In the others the texts outside of the
largest component are compared with all, in tiles of bounded size and by a second signature that rules out what is
clearly less similar. No pair leaves its tile: texts with a partner left, of which the tile is the one to look at the
pair, come back to it with their full sets, and links that tie components together go out, at most one less than these.

With ``MATCHES`` of 36 in 64, a pair of similarity 0.8 is missed with a probability of 4 in a million (binomial).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import WordHashes, mixed, nothing_kept
from queuelens.session import arrow_batches, cut_lineage

COORDINATES, MATCHES = 64, 36
#: Two signatures with MATCHES equal places share one of so many lists, whatever the order of all lists.
PREFIX = COORDINATES - MATCHES + 1
#: Parts of the range of hashes whose smallest members make up a text's second, short signature.
BINS = 256
#: Standard deviations below the wanted similarity at which the second signature rules a pair out.
DOUBT = 5.0
#: Texts outside of a list's largest component that one task compares with others at a time, how many of these for
#: each, and the members of their sets for each.
TILE, PASSING, MEMBERS = 256, 4, 4096
#: Pairs whose bins are compared at once.
PAIRS = 8192
#: Rows with texts or sets that are handed to Python at a time.
BATCH = 1000
#: The links of one text are confirmed by up to so many tasks.
SPREAD = 16
#: Times that every list is held against a central text before the rest is compared directly.
STARS = 2
#: Words that a task remembers, some 200 bytes each.
WORDS = 100_000
SEED = 0x5EED
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's word hashes; a shorter text is one shingle, none is none."""
    n = len(words)
    if n == 0:
        return words
    span = min(width, n)
    h = mixed(words[:n - span + 1] + np.uint64(span))
    for k in range(1, span):
        h = mixed(h + words[k:n - span + 1 + k])
    return np.unique(h)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(1, 1 << 63, (2, COORDINATES, 1), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signature(h: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Upper halves of the smallest value under each permutation, worked through in pieces of bounded size."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 4096):
        low = np.minimum(low, (h[k:k + 4096] * factor + shift).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def bins_of(h: np.ndarray) -> bytes:
    """A byte of the smallest hash in each of ``BINS`` equal parts of the range, 0 for a part without a hash."""
    spread = np.sort(mixed(h ^ np.uint64(SEED + 1)))
    starts = np.searchsorted(spread, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    ends = np.append(starts[1:], len(spread))
    first = spread[np.minimum(starts, len(spread) - 1)]
    return np.where(ends > starts, first % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def plausible(mine: np.ndarray, others: np.ndarray, n: int, ns: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``ns`` members with these bins may be as similar as wanted.

    The share of equal bins among those in use is the similarity of a sample of the union, drawn without
    replacement: pairs more than DOUBT standard deviations below ``percent`` are ruled out (3 in ten million of those
    exactly at it). Small sets have nearly all of their members in bins of their own and are judged almost exactly.
    """
    wanted = percent / 100
    used = ((others != 0) | (mine != 0)).sum(axis=1)
    same = ((others == mine) & (mine != 0)).sum(axis=1)
    union = np.maximum((n + ns) / (1 + wanted), used)
    deviation = np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1) * (1 - used / union)) + 0.1 / np.maximum(used, 1)
    return same >= (wanted - DOUBT * deviation) * used


def _sets(texts: list[str | None], hashes: WordHashes, width: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(hashes((text or "").encode().translate(LOWER).split()), width)


def set_hash(h: np.ndarray, seed: int) -> int:
    """A hash of a set: the sum of its scrambled members."""
    return int(mixed(h ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64))


def _signed(width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_kept()
        hashes, (factor, shift) = WordHashes(WORDS), permutations()
        for rows in batches:
            out = [(len(h), set_hash(h, SEED), signature(h, factor, shift).view("<i4"), bins_of(h)) if len(h) else (0, 0, None, None)
                   for h in _sets(rows["text"].tolist(), hashes, width)]
            made = pd.DataFrame(out, columns=["n", "node", "sig", "bins"])
            made.insert(0, "id", rows["id"].astype("Int64"))
            yield made

    return run


def _spans(rows: pd.DataFrame, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values, start, end) of each stretch of rows that agree in ``columns``."""
    tag = rows[columns].to_numpy()
    cuts = [0, *(np.flatnonzero((tag[1:] != tag[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
    return ((tuple(tag[s].tolist()), s, e) for s, e in zip(cuts, cuts[1:]) if e > s)


def alike(mine: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.concatenate([mine, other])
    both.sort(kind="stable")  # two sorted runs are merged
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(mine) + len(other) - same)


def _confirmed(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links from rows sorted by (a, salt, role): the set of ``a`` comes first and is kept while the others pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_kept()
        where, mine = None, None
        for rows in batches:
            found = []
            for (a, salt, role), start, end in _spans(rows, ["a", "salt", "role"]):
                part = rows.iloc[start:end]
                if role == 0:
                    where, mine = (a, salt), np.frombuffer(part["set"].iloc[0], np.uint64)
                    continue
                if where != (a, salt):
                    raise ValueError("a set is missing")
                for b, other in zip(part["b"].tolist(), part["set"], strict=True):
                    if alike(mine, np.frombuffer(other, np.uint64), percent):
                        found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


class Texts(NamedTuple):
    """Columns of some texts of a tile; ``sets`` may be missing."""

    ids: np.ndarray
    comps: np.ndarray
    ns: np.ndarray
    bins: np.ndarray
    keys: np.ndarray
    sets: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Texts:
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), BINS)
        return cls(*(rows[c].to_numpy() for c in ("id", "comp", "n")), bins, rows["keys"].to_numpy(), rows["set" if "set" in rows else "keys"].to_numpy())

    def span(self, start: int, end: int) -> Texts:
        return Texts(*(x[start:end] for x in self))


class Tile:
    """Texts of one list that are held while others pass."""

    def __init__(self, key: int):
        self.key = key
        self.parts: list[Texts] = []
        self.earlier: dict[int, frozenset[int]] = {}
        self.root: dict[int, int] = {}

    @property
    def held(self) -> Texts:
        if len(self.parts) > 1:
            self.parts = [Texts(*map(np.concatenate, zip(*self.parts, strict=True)))]
        return self.parts[0]

    def pairs(self, others: Texts, percent: int) -> Iterator[tuple[int, int]]:
        """Places of held and passing texts that may be similar, are of two components and share no earlier list.

        Earlier lists are those with smaller keys: of the lists that two texts share, the first looks at the pair.
        """
        held = self.held
        step = max(1, PAIRS // len(others.ids))
        for start in range(0, len(held.ids), step):
            comps, ns = held.comps[start:start + step, None], held.ns[start:start + step, None]
            i, j = np.nonzero((comps != others.comps) & (100 * np.minimum(ns, others.ns) >= percent * np.maximum(ns, others.ns)))
            i += start
            fit = plausible(held.bins[i], others.bins[j], held.ns[i], others.ns[j], percent)
            for one, two in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                if one not in self.earlier:
                    keys = held.keys[one]
                    self.earlier[one] = frozenset(keys[keys < self.key].tolist())
                if self.earlier[one].isdisjoint(others.keys[two].tolist()):
                    yield one, two

    def find(self, comp: int) -> int:
        while (up := self.root.get(comp, comp)) != comp:
            self.root[comp] = self.root.get(up, up)
            comp = up
        return comp


TILE_KEY = ["key", "one", "two"]


def _tiles(rows: pd.DataFrame, tile: Tile | None, where: tuple | None) -> Iterator[tuple[tuple, Tile, int, Texts]]:
    """(tile's key, tile, place of the first row, passing texts) from rows sorted by (key, one, two, role).

    The texts of role 0, ``TILE`` or so, are held; those of role 1 pass. ``tile`` is the one the rows before ended in.
    """
    texts = Texts.of(rows)
    for (*here, role), start, end in _spans(rows, [*TILE_KEY, "role"]):
        part = texts.span(start, end)
        if role == 0:
            if where != tuple(here):
                where, tile = tuple(here), Tile(here[0])
            tile.parts.append(part)
            yield where, tile, start, part.span(0, 0)
        elif where != tuple(here):
            raise ValueError("a tile is incomplete")
        else:
            yield where, tile, start, part


def _tile_texts(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The texts of a tile that have a plausible partner in it."""
    columns = [*TILE_KEY, "role", "id", "comp"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_kept()
        where, tile, met = None, None, {}
        for rows in batches:
            ended, hit = [], np.zeros(len(rows), bool)
            for here, tile, start, others in _tiles(rows, tile, where):
                if here != where:
                    ended += [(*where, 0, i, c) for i, c in met.items()] if met else []
                    where, met = here, {}
                if len(others.ids):
                    for one, two in tile.pairs(others, percent):
                        hit[start + two] = True
                        met[int(tile.held.ids[one])] = int(tile.held.comps[one])
            yield pd.concat([rows.loc[hit, columns], pd.DataFrame(ended, columns=columns, dtype="int64")])
        yield pd.DataFrame([(*where, 0, i, c) for i, c in met.items()], columns=columns, dtype="int64")

    return run


def _tile_links(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links between the components of a tile by full sets; components that others tie together get none of their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_kept()
        where, tile = None, None
        for rows in batches:
            found = []
            for where, tile, _, others in _tiles(rows, tile, where):
                if not len(others.ids):
                    continue
                held = tile.held
                for one, two in tile.pairs(others, percent):
                    a, b = tile.find(int(held.comps[one])), tile.find(int(others.comps[two]))
                    if a != b and alike(np.frombuffer(held.sets[one], np.uint64), np.frombuffer(others.sets[two], np.uint64), percent):
                        tile.root[max(a, b)] = min(a, b)
                        found.append((held.ids[one], others.ids[two]))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """(key, id, central): the lists of each text's prefix that hold two texts or more.

    ``central`` is the length of all lists of a text together.
    """
    postings = nodes.select("id", F.posexplode("sig").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    own = postings.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("lists"), F.sum("size").alias("central"))
    # lists of one text are a text's rarest and take up its prefix first
    left = F.size("lists") - (COORDINATES - PREFIX)
    members = cut_lineage(own.filter(left > 0).select("id", "central", F.explode(F.slice("lists", F.lit(1), left)).alias("l")).select("l.key", "id", "central"))
    met = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return members.join(met, "key", "left_semi")


def full_sets(ids: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(id, set) of the nodes with these ids."""
    wanted = nodes.join(ids.distinct(), "id", "left_semi").select(F.col("rep").alias("id")).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_kept()
        hashes = WordHashes(WORDS)
        for part in batches:
            made = [(set_hash(h, SEED), h.tobytes()) for h in _sets(part["text"].tolist(), hashes, width)]
            yield pd.DataFrame(made, columns=["id", "set"])

    with arrow_batches(nodes.sparkSession, BATCH):
        full = cut_lineage(rows.join(wanted, "id", "left_semi").select("text").mapInPandas(sets, "id long, set binary"))
    if not full.groupBy("id").count().filter("count > 1").isEmpty():  # rows that repeat an id
        full = full.dropDuplicates(["id"])
    return full


def confirm(candidates: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """The candidate pairs (a, b) of nodes whose signatures agree enough and whose full sets are similar enough.

    ``a`` is the side that has many partners: its set is sent once to each task that confirms some of them.
    """
    sigs = nodes.select("id", "sig", "n")
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = cut_lineage(
        candidates.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a")
        .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b")
        .filter(near & (same >= MATCHES)).select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int").alias("salt")))
    full = full_sets(likely.select(F.explode(F.array("a", "b")).alias("id")), nodes, rows, width)
    centres = likely.select("a", "salt").distinct().join(full.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "set")
    others = likely.join(full.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "set")
    sent = centres.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    with arrow_batches(nodes.sparkSession, BATCH):
        return cut_lineage(sent.mapInPandas(_confirmed(percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id each linked id can reach.

    Links are turned towards ever smaller neighbours until every one points at the smallest of its component: each
    round ties all larger neighbours of an id to its smallest one, then all smaller ones. Rounds grow with the
    logarithm of a component's extent and go on until nothing changes; each is written to the shared folder.
    """
    links = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = cut_lineage(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp"))
    return found.unionByName(found.select(F.col("comp").alias("id"), "comp").distinct())


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, central, comp) of the lists whose texts are not one component yet."""
    marked = members.join(components(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lists = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    return cut_lineage(marked.join(lists, "key", "left_semi"))


def similar_nodes(nodes: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that tie together all nodes of a component. ``nodes``: id, rep, n, sig, bins; ``rows``: id, text."""
    spark = nodes.sparkSession
    left = cut_lineage(prefix_lists(nodes).withColumn("comp", F.col("id")))
    # empty ranges: an empty list would be read by Python workers of another kind, beside those that are there
    links, tried = (spark.range(0).select(F.col("id").alias(x), F.col("id").alias(y)) for x, y in (("a", "b"), ("key", "first_comp")))
    for _ in range(STARS):
        # the most central text of each list, of a component that was not its centre before
        fresh = left.join(tried, (left["key"] == tried["key"]) & (left["comp"] == tried["first_comp"]), "left_anti")
        firsts = fresh.groupBy("key").agg(F.max(F.struct("central", F.xxhash64("id").alias("h"), "id", "comp")).alias("f"))
        firsts = cut_lineage(firsts.select("key", F.col("f.id").alias("first"), F.col("f.comp").alias("first_comp")))
        star = (left.join(firsts, "key").filter("id <> first and comp <> first_comp").groupBy(F.col("first").alias("a"), F.col("id").alias("b"))
                .agg(F.count(F.lit(1)).alias("collisions")).select("a", "b"))
        links = cut_lineage(links.unionByName(confirm(star, nodes, rows, percent, width)))
        left = _unsettled(left.select("key", "id", "central"), links)
        if left.isEmpty():
            return links
        now = left.select("key", "id", F.col("comp").alias("first_comp"))
        tried = cut_lineage(firsts.select("key", F.col("first").alias("id")).join(now, ["key", "id"]).select("key", "first_comp"))
    return links.unionByName(tile_links(left, nodes, rows, percent, width))


def tile_links(left: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between the components of ``left``: texts outside of a list's largest component against all of the list."""
    left = left.select("key", "id", "comp").join(nodes.select("id", "n"), "id")
    sizes = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("texts", "comp", "members")).alias("top"), F.sum("texts").alias("texts"), F.sum("members").alias("members"))
    plan = largest.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("texts") / (PASSING * TILE)).cast("int").alias("parts"),
                          F.ceil(F.greatest((F.col("texts") - F.col("top.texts")) / TILE, (F.col("members") - F.col("top.members")) / (TILE * MEMBERS))).cast("int").alias("tiles"))
    listed = left.join(plan, "key").withColumns({"one": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "two": F.pmod(F.xxhash64("id", F.lit(1)), F.col("tiles")).cast("int")})
    held = listed.filter("comp <> top").select("key", "id", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("one"), "two", F.lit(0).alias("role"))
    passing = listed.select("key", "id", "comp", "one", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("two"), F.lit(1).alias("role"))
    whole = held.select(*TILE_KEY).distinct()  # a tile without a held text has nothing to compare
    known = cut_lineage(left.groupBy("id").agg(F.collect_list("key").alias("keys")).join(nodes.select("id", "n", "bins"), "id"))

    def dealt(texts: DataFrame, *more: str) -> DataFrame:
        return (texts.join(known, "id").select(*TILE_KEY, "role", "id", "comp", "n", "bins", "keys", *more)
                .repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "role"))

    tiles = dealt(held.unionByName(passing.join(whole, TILE_KEY, "left_semi")))
    with arrow_batches(nodes.sparkSession, BATCH):
        near = cut_lineage(tiles.mapInPandas(_tile_texts(percent), "key long, one int, two int, role int, id long, comp long"))
        full = full_sets(near.select("id"), nodes, rows, width)
        return cut_lineage(dealt(near.join(full, "id"), "set").mapInPandas(_tile_links(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Component of every document among texts whose shingle sets have 100 * intersection >= percent * union.

    Columns: key, n_shingles, component_id (the smallest id that can be reached, itself included), kept (the
    document is that one). A-Z are lowered and words lie between ASCII white space; a text of fewer than ``width``
    words is one shingle, one without words (or null) has none and is linked with nothing. Rows without an id are
    not linked, have no component and are kept. Repeated ids count as one document where texts are compared. Keys
    must be whole numbers. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with arrow_batches(docs.sparkSession, BATCH):
        signed = cut_lineage(rows.mapInPandas(_signed(width), "id long, n long, node long, sig array<int>, bins binary"))
    able = signed.filter("n > 0 and id is not null")
    nodes = cut_lineage(able.groupBy(F.col("node").alias("id")).agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bins").alias("bins")))
    linked = components(similar_nodes(nodes, rows, percent, width))
    reps = nodes.select("id", "rep").join(linked, "id")
    least = reps.groupBy("comp").agg(F.min("rep").alias("least"))
    found = nodes.select(F.col("id").alias("node"), "rep").join(
        reps.join(least, "comp").select(F.col("id").alias("node"), "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("comp"))
    grouped = able.select("id", "n", "node").join(found, "node").select("id", "n", "comp")
    alone = signed.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("comp"))
    return grouped.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
                                             F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))
