"""Every text operator against plain Python on small tables: nulls, empty and long texts, ties, repeats, no rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from queuelens.llm import bpe, common, imatch, linedup, mixing, neardup, pseudonyms, quality, risk, spelling, token_files, toxicity
from queuelens.session import arrow_batches

SCHEMA = "doc_id long, text string, source string, lang string, size int, id string, _text string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, s, "en", 7, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, a null id, a repeated row, a long text, letters of many scripts."""
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (None, "some words here", "a"), (5, "same row", "a"), (5, "same row", "a"),
            (6, "lorem ipsum dolor " * 20_000, "a"), (7, "naïve 日本語 \U0001f600 ünï code <|endoftext|> x", "b"), (8, "don't  stop\r\n\r\nnow!!   ", "c")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


# --- token files ----------------------------------------------------------

def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, none):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.round_trip(odd, spark).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.round_trip(none, spark).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 30_000])
def test_blocks_come_back(n):
    draw = np.random.default_rng(n)
    ids = np.where(draw.random(n) < 0.5, draw.integers(0, 65_536, n), np.arange(n) % 7)
    assert (token_files.unpack(token_files.pack(ids.astype(np.int64))) == ids).all()


def test_skewed_ids_shrink_and_damage_is_seen():
    ids = np.tile(np.array([5, 9, 9, 1], np.int64), 5_000)
    packed = token_files.pack(ids)
    assert len(packed) < len(ids) / 4
    broken = bytearray(packed)
    broken[-20] ^= 0xFF
    with pytest.raises(ValueError):
        token_files.unpack(bytes(broken))
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << 16]))


@pytest.mark.parametrize("n", [511, 512, 513, 100_000])
def test_streams_are_short_and_share_models(monkeypatch, n):
    """A block takes as many steps as its streams have ids, not 4,096, and still shrinks."""
    steps = []
    real = token_files.Model.predictions
    monkeypatch.setattr(token_files.Model, "predictions", lambda self, k: (steps.append(k), real(self, k))[1])
    draw = np.random.default_rng(n)
    ids = np.where(draw.random(n) < 0.3, draw.integers(0, 65_536, n), np.arange(n) % 50)
    packed = token_files.pack(ids.astype(np.int64))
    assert len(steps) <= 512 and sum(steps) == n
    assert n < 100_000 or len(packed) < 1.5 * n
    assert (token_files.unpack(packed) == ids).all()


def test_words_are_merged_once_and_ids_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, ids_of = Tokenizer.from_file(path), token_files.TextIds(path)
    texts = ["Word, word. WORD! (word) word's", "don't I'LL abc,'s x<|endoftext|>y X<|ENDOFTEXT|>", "é, É. naïve, ÀÖØÞ! ß; İ, \u017f. e\u0301, x\u0302, \u212a: 1, a1, ०,"]
    draw = random.Random(3)
    signs = "abcXYZ'\u2019.,;:!?#%&*$|<>()\"-_éÉßÿ×÷ñİſ\u0302\u0327ª09 日\n\t\u0085\x1c"
    texts += ["".join(draw.choice(signs) for _ in range(draw.randrange(1, 40))) for _ in range(5_000)]
    assert [x.tolist() for x in ids_of(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert b"word" in ids_of.words and not any(w[-1:] in b".,!" for w in ids_of.words)


def test_token_files_look_up_a_piece_once(monkeypatch):
    asked, real = [], token_files.TextIds.of_pieces
    monkeypatch.setattr(token_files.TextIds, "of_pieces", lambda self, pieces: (asked.extend(pieces.to_pylist()), real(self, pieces))[1])
    path = public_tokenizers.path(token_files.TOKENIZER)
    tok, texts = Tokenizer.from_file(path), ["Alpha beta. alpha,\u00a0x", "", " beta. 12 Alpha\n", "x<|endoftext|>Alpha \u4e2d", "alpha"] * 50
    assert [x.tolist() for x in token_files.TextIds(path)(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and len(asked) == len(set(asked))


def test_a_worker_keeps_the_memory_of_one_operator(spark, monkeypatch):
    path = public_tokenizers.path(bpe.TOKENIZER)
    assert bpe.byte_pairs(path) is bpe.byte_pairs(path) and common._KEPT
    for task in (neardup._signed(5), neardup._confirmed(80), neardup._tile_texts(80), neardup._tile_links(80)):
        bpe.byte_pairs(path)
        list(task(iter([])))
        assert not common._KEPT
    # no list of the driver's goes through Python workers of another kind
    docs = spark.createDataFrame([(k, "a b c d e f g h " * 3 + "x" * (k % 2)) for k in range(4)], "doc_id long, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert neardup.near_duplicates(docs).count() == 4


# --- quality and toxicity -------------------------------------------------

def accuracy(scored, marks, name):
    rows = scored.filter("held_out").join(marks, "doc_id").select("score", name).collect()
    good, bad = [r["score"] for r in rows if r[name] == 1], [r["score"] for r in rows if r[name] == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, kind, odd, none):
    from queuelens.llm.common import documents, labels
    folder = "/root/testdata/sf0.01"
    docs, marks = documents(spark, folder), labels(spark, folder)
    if kind == "quality":
        train, score = quality.train, quality.score_quality
    else:
        train, score = toxicity.train, toxicity.score_toxicity
    model = train(docs, marks)
    out = score(docs, model)
    assert out.count() == docs.count()
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    held = {r["doc_id"]: r["held_out"] for r in out.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())
    assert accuracy(out, marks, kind) > 0.7
    rows = score(odd, model).collect()
    assert len(rows) == 9 and len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert score(none, model).count() == 0
    untaught = train(none, marks.limit(0))
    assert score(odd, untaught).count() == 9


def test_labels_of_held_out_rows_are_not_read(spark):
    from queuelens.llm.common import documents, held_out, labels
    docs, marks = documents(spark, "/root/testdata/sf0.001"), labels(spark, "/root/testdata/sf0.001")
    turned = marks.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_quality(docs, quality.train(docs, m)).select("doc_id", "score") for m in (marks, turned))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_quality_stage_keeps_whole_rows(spark, odd):
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns


def test_chain_marginals_equal_enumeration():
    draw = np.random.default_rng(3)
    emission, start, trans = draw.normal(size=(1, 6)), draw.normal(size=2), draw.normal(size=(2, 2))
    p, _ = toxicity.marginals(emission, np.array([5]), start, trans)
    total, on = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        w = math.exp(start[y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(emission[0, k] * y[k] for k in range(5)))
        total += w
        on += w * np.array(y)
    assert np.allclose(p[0, :5], on / total) and p[0, 5] == 0


def test_spans():
    p = np.array([0.1, 0.9, 0.8, 0.2, 0.7])
    assert toxicity.spans("é bad  worse ok end", p) == [(2, 12), (16, 19)]


# --- pseudonyms -----------------------------------------------------------

def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_their_format(spark, odd, none):
    lines = ["card 4111 1111 1111 1111 date 2021-02-28 ip 10.0.0.255 ssn 123-45-6789 phone (212) 555-0187 mail Jo.Doe99@example.org",
             "again 4111 1111 1111 1111, 10.0.0.255 and 123-45-6789.", "no card 4111 1111 1111 1112, no day 2021-02-30", "plain", ""]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(lines)])
    got = [r["text"] for r in pseudonyms.pseudonymise(docs, "secret").orderBy("doc_id").collect()]
    card, day, ip, ssn, phone, mail = re.fullmatch(r"card ([\d ]{19}) date (\S{10}) ip (\S+) ssn (\S+) phone (.{14}) mail (\S+)", got[0]).groups()
    assert luhn(card) and card != "4111 1111 1111 1111" and card[0] == "4" and [i for i, c in enumerate(card) if c == " "] == [4, 9, 14]
    assert date.fromisoformat(day) and day != "2021-02-28"
    assert ip != "10.0.0.255" and all(0 <= int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r"(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}", ssn) and ssn != "123-45-6789"
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", phone)
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d\d@example\.org", mail)
    assert got[1] == f"again {card}, {ip} and {ssn}." and got[2:] == lines[2:]
    other = pseudonyms.pseudonymise(docs, "another").orderBy("doc_id").first()["text"]
    assert other != got[0]
    kept = pseudonyms.pseudonymise(odd, "secret")
    assert kept.columns[:7] == odd.columns
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in (odd, kept))
    assert before == after and pseudonyms.pseudonymise(none, "s").count() == 0


def test_permutation_is_one_to_one(spark):
    rows = spark.range(500).select(pseudonyms.permuted(F.col("id"), F.lit(500).cast("long"), "k", "t").alias("p"))
    assert sorted(r["p"] for r in rows.collect()) == list(range(500))


# --- fingerprints ---------------------------------------------------------

def test_fingerprints(spark, odd, none, texts):
    docs = table(spark, [(i, t, "s") for i, t in texts])
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs, spark).collect()}
    order = sorted(dict(texts), reverse=True)
    text = {i: t or "" for i, t in texts}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text[i]) // 3
        changed = text[i][:len(text[i]) - cut] + text[j][:cut]
        assert got[i]["n_chars"] == len(text[i]) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b = (np.frombuffer(bytes.fromhex(got[k]["fingerprint"]), "<u2") for k in (i, j))
        assert got[i]["near_next"] == imatch.alike(a, b) and 0 <= got[i]["near_edited"] <= 1
    by_text = {}
    for i in order:
        assert by_text.setdefault(text[i], got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.2
    assert imatch.fingerprints(odd, spark).count() == 9 and imatch.fingerprints(none, spark).count() == 0


# --- rules ----------------------------------------------------------------

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            hit.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark, odd, none, texts):
    marks = spark.createDataFrame([], "doc_id long, quality int")
    extra = [(-1, "a b c d a b c x\nq\nq\n\n", "s"), (-2, "$# %d <|>\n" * 3, "s")]
    docs = table(spark, [(10_000 + i, t, "s") for i, t in texts] + extra).unionByName(odd)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in risk.quality_rules(docs, marks).collect():
        want = plain_counts(text[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])  # no labels, no certified cutoff
    assert risk.quality_rules(none, marks).count() == 0


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 7, 60, 400) for k in range(0, n, max(1, n // 9))]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", risk.binomial_tail(F.col("k"), F.col("n"), 0.07).alias("p"))
    for k, n, p in map(tuple, got.collect()):
        want = 1.0 if k >= n * 0.07 else sum(math.comb(n, i) * 0.07 ** i * 0.93 ** (n - i) for i in range(k + 1))
        assert abs(p - want) < 1e-9


def test_certified_cutoffs_reject_few_good(spark):
    from queuelens.llm.common import documents, labels
    folder = "/root/testdata/sf0.01"
    out = risk.quality_rules(documents(spark, folder), labels(spark, folder)).join(labels(spark, folder), "doc_id")
    r = out.filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert r >= 0.94


# --- near duplicates ------------------------------------------------------

def plain_components(rows, percent, width, common=4000):
    lower = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    sets = {i: {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for i, w in lower.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in where.values() if len(ids) < common for a in ids for b in ids if a < b}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, texts, width):
    draw = random.Random(5)
    long = [f"w{draw.randrange(9000)}" for _ in range(300)]
    rows = list(texts) + [(-1, None), (-2, ""), (-3, "one"), (-4, "ONE"), (-5, "two words"), (-6, "two  Words\n")]
    for k in range(40):  # a chain: neighbours are alike, ends are not
        long[k * 3] = f"n{k}"
        rows.append((1_000_000 + k, " ".join(long)))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(table(spark, [(i, t, "s") for i, t in rows]), 80, width).collect()}
    want = plain_components(rows, 80, width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = neardup.near_duplicates(odd, 80, 2).collect()
    assert len(rows) == 9 and all(r["kept"] for r in rows)
    assert neardup.near_duplicates(none).count() == 0


def met_pairs(spark, monkeypatch, rows):
    """(components, pairs whose signatures were looked at)."""
    met = []

    def counting(candidates, *rest):
        met.append(candidates.count())
        return real(candidates, *rest)
    real = neardup.confirm
    monkeypatch.setattr(neardup, "confirm", counting)
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, rows), 80, 2).collect()}
    monkeypatch.setattr(neardup, "confirm", real)
    return out, sum(met)


def test_texts_that_share_a_passage_are_not_paired(spark, monkeypatch):
    """Half of the words in common, none alike: nearly no pairs are met, however many texts there are."""
    draw = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, passage + " " + " ".join(f"w{draw.randrange(10**9)}" for _ in range(100)), "s") for i in range(600)]
    found, met = met_pairs(spark, monkeypatch, rows)
    assert found == {i: i for i, _, _ in rows} and met < 600


@pytest.mark.parametrize("middle", [True, False])
def test_a_large_group_of_edited_copies(spark, monkeypatch, middle):
    """Copies are alike to the text they were made from and mostly not to each other; without it, some are to some."""
    draw = random.Random(4)
    origin = [f"o{i}" for i in range(200)]
    rows = [(0, " ".join(origin), "s")] if middle else []
    for i in range(1, 500):
        words = list(origin)
        for k in draw.sample(range(200), 9):
            words[k] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(words), "s"))
    found, met = met_pairs(spark, monkeypatch, rows)
    want = plain_components([(i, t) for i, t, _ in rows], 80, 2, 10**6)
    assert found == {i: c for i, (_, c) in want.items()}
    if middle:
        assert len(set(found.values())) == 1 and met < 8 * len(rows)


def test_pairs_of_copies_without_a_centre_stay_in_their_tile(spark, monkeypatch):
    """Hundreds of texts just below or above the limit: rows that leave the tiles are as many as texts, not as pairs."""
    made, kept = [], neardup.cut_lineage
    real = neardup.tile_links

    def counting(*args):
        monkeypatch.setattr(neardup, "cut_lineage", lambda df: (made.append(kept(df)), made[-1])[1])
        links = real(*args)
        monkeypatch.setattr(neardup, "cut_lineage", kept)
        return links
    monkeypatch.setattr(neardup, "tile_links", counting)
    draw = random.Random(9)
    origin = [f"o{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(origin)
        for k in draw.sample(range(200), 10):
            words[k] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(words), "s"))
    found, met = met_pairs(spark, monkeypatch, rows)
    want = plain_components([(i, t) for i, t, _ in rows], 80, 2, 10**6)
    assert found == {i: c for i, (_, c) in want.items()}
    assert len(set(found.values())) > 1 and met < neardup.PREFIX * len(rows)
    near, links = made[1], made[-1]
    assert near.columns[:4] == ["key", "one", "two", "role"] and links.columns == ["a", "b"]
    lists = made[0].select(F.explode("keys")).count()
    assert near.count() <= 2 * lists and links.count() < lists


def test_batches_are_small_for_a_while(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for rows in batches:
            yield pd.DataFrame({"n": [len(rows)]})
    with arrow_batches(spark, 700):
        inside = [r["n"] for r in spark.range(0, 2000, 1, 1).mapInPandas(sizes, "n long").collect()]
        with arrow_batches(spark, 5000):
            assert spark.conf.get(name) == "700"
    assert sum(inside) == 2000 and max(inside) <= 700 and spark.conf.get(name) == before


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["comp"] for r in neardup.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# --- mixing ---------------------------------------------------------------

def test_mixing(spark, odd, none):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randrange(1, 60), "big" if i % 3 else draw.choice(["s1", "s2", None])) for i in range(3000)]
    out = mixing.mix_sources(table(spark, rows))
    got = {r["doc_id"]: r for r in out.collect()}
    size, source = Counter(), {i: s for i, _, s in rows}
    for i, t, s in rows:
        size[s] += len(t.split())
    weights = {s: w for s, w in zip(["big", "s1", "s2", None], [1, 2, 3, 1], strict=True)}
    left, target, open_ = sum(size.values()), {}, set(weights)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        for s in full or open_:
            target[s] = 3 * size[s] if full else share[s]
        left -= sum(3 * size[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for i, r in got.items():
        s = source[i]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * target[s]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(60, 0.001 * target[s]) for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(table(spark, rows)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix_sources(odd).count() == 9 and mixing.mix_sources(none).count() == 0


def test_ranks_run_through_the_parts_of_a_size(spark):
    """Many documents of one size: no copy is lost between the parts that rank them."""
    rows = [(i, "one two three four five", "big") for i in range(9000)] + [(20_000 + i, "a b c", None) for i in range(3000)]
    out = mixing.mix_sources(table(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert set(taken) == {45_000, 9000} and all(abs(taken[s] - target[s]) <= 2.5 for s in taken)


# --- BPE ------------------------------------------------------------------

def test_bpe(spark, odd, none, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    docs = odd.unionByName(table(spark, [(100 + i, t, "s") for i, t in texts]))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.encode_decode(docs).collect():
        ids = tok.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert bpe.encode_decode(none).count() == 0
    back = bpe.decode(bpe.encode(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == text


def test_bpe_on_random_strings():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = bpe.BytePairs(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(9)
    made = ["".join(draw.choice("aabcdeé 0.,\n\t'日A  ") for _ in range(draw.randrange(400))) for _ in range(300)]
    made.append("ab" * 3000)
    for text, (ids, decimal, raw) in zip(made, mine.encode(made), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
        assert decimal == ",".join(map(str, ids)) and raw.decode() == text == mine.decode(ids.tolist())


# --- lines ----------------------------------------------------------------

def test_lines(spark, odd, none):
    rows = [(i, f"own {i}\n Shared line \nmore {i}\n\nend", f"site{i % 6}") for i in range(30)]
    rows += [(100 + i, f"own {i}\nfour sites only\nend {i}", f"site{i % 4}") for i in range(20)]
    rows += [(200, "Shared line\nShared line", "x"), (201, None, None), (202, "", "x")]
    out = {r["doc_id"]: r for r in linedup.remove_shared_lines(table(spark, rows)).collect()}
    for i, t, _ in rows:
        r = out[i]
        if i < 30:
            assert r["text"] == f"own {i}\nmore {i}\n" and r["n_removed"] == 2
        elif i < 200:
            assert r["text"] == t and r["n_removed"] == 0
    assert out[200]["left_alone"] and out[200]["text"] == "Shared line\nShared line"
    assert out[201]["text"] is None and out[201]["n_lines"] == 0 and out[202]["text"] == ""
    kept = linedup.remove_shared_lines(odd)
    assert kept.columns[:7] == odd.columns and kept.count() == 9
    assert linedup.remove_shared_lines(none).count() == 0


# --- columns of a user's own ----------------------------------------------

CLASHING = ["_id", "_found", "_lines", "_parts", "_new", "id", "h", "site", "line", "node", "n", "sig", "comp", "key", "_text", "_key", "_size", "_source", "_part",
            "kept_id", "times", "place", "mixed_id", "copies", "copy", "word", "letters", "box", "doc", "head", "tail", "score", "_copies"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "Write to ann@example.com today\nshared line", "a"), (2, "other text\nshared line", "b"), (2, "other text\nshared line", "b"),
            (3, None, None), (None, "no id here", "c"), (None, "no id here", "c"), (4, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    return df.withColumns({name: F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in CLASHING})


def own_columns(df):
    return sorted((r["doc_id"] or 0, *(r[c] for c in CLASHING)) for r in df.select("doc_id", *CLASHING).collect())


@pytest.mark.parametrize("operator", ["lines", "pseudonyms"])
def test_columns_named_like_internal_ones_survive(clashing, operator):
    out = linedup.remove_shared_lines(clashing, min_sites=2) if operator == "lines" else pseudonyms.pseudonymise(clashing, "secret")
    assert own_columns(out) == own_columns(clashing)


@pytest.mark.parametrize("operator", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op13"])
def test_columns_named_like_internal_ones_do_no_harm(spark, clashing, operator):
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    made = {"op1": lambda: token_files.round_trip(clashing, spark, public_tokenizers.path(token_files.TOKENIZER)),
            "op2": lambda: quality.score_quality(clashing, quality.train(clashing, marks)), "op4": lambda: imatch.fingerprints(clashing, spark),
            "op5": lambda: risk.quality_rules(clashing, marks), "op6": lambda: neardup.near_duplicates(clashing),
            "op7": lambda: mixing.mix_sources(clashing), "op8": lambda: bpe.encode_decode(clashing),
            "op9": lambda: toxicity.score_toxicity(clashing, toxicity.train(clashing, marks)), "op13": lambda: spelling.spelling_variants(clashing)}[operator]()
    assert made.count() == (0 if operator == "op13" else 7)


@pytest.mark.parametrize("stage", ["quality", "lines", "near_duplicates", "mixing"])
def test_stages_keep_a_users_columns(spark, data, clashing, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, clashing, data)
    assert out.columns == clashing.columns
    got, given = own_columns(out), own_columns(clashing)
    assert set(got) <= set(given)
    if stage == "near_duplicates":  # repeated rows, with and without an id, leave one each
        assert len(got) == 5 and len(set(got)) == 5
