"""Whitening, page text and spelling variants against plain Python: nulls, odd rows, ties, repeats, no rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from queuelens.llm import bidiagonal, kdtree, spelling, whitening
from queuelens.llm.html_text import extract_text, main_text

# --- whitening ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id string, x int, n int, i int"


def vectors(spark, rows):
    """Embeddings beside columns named like those used inside."""
    return spark.createDataFrame([(k, v, "y", 7, 8, 9) for k, v in rows], VECTORS)


def plain_whitening(rows):
    x = np.array([np.floor(64 * np.array(v, dtype=float)) + 1_000_000 for _, v in rows])
    n = len(x)
    c = x - x.sum(axis=0) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = int((e > 1e-9 * e[0]).sum())
    return n, ((n * x - x.sum(axis=0)) ** 2).sum(axis=1), (c @ v)[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_equals_eigenvectors(spark, data):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    bad = [(-1, None), (-2, [float("nan")] * 64), (-3, [float("inf")] * 64), (-4, [None] * 64), (-5, []), (-6, [1.0, 2.0])]
    out = whitening.whiten(vectors(spark, rows + bad)).collect()
    n, deviation, whitened, share = plain_whitening(rows)
    assert len(out) == 32 * len(rows)
    at = {k: i for i, (k, _) in enumerate(rows)}
    for r in out:
        i, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(abs(r["whitened"]) - abs(whitened[i, c])) < 1e-8 and abs(r["explained"] - share[c]) < 1e-12
        assert r["identity_error"] < 1e-9
    signs = defaultdict(set)
    for r in out:
        w = whitened[at[r["vec_id"]], r["component"] - 1]
        if abs(w) > 1e-6:
            signs[r["component"]].add(r["whitened"] * w > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_tables(spark):
    draw = random.Random(3)
    rows = [(i // 2, [draw.gauss(0, 3), draw.gauss(1, 1), draw.gauss(0, 0.5)]) for i in range(200)] + [(None, [1.0, 2.0, 3.0])] * 3
    out = whitening.whiten(vectors(spark, rows), components=2)
    assert out.count() == 2 * 203 and out.filter("vec_id is null").count() == 6 and out.first()["identity_error"] < 1e-10
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert flat.collect() == [] and flat.columns == out.columns
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(10)])).collect()
    assert {r["component"] for r in line} == {1} and all(r["explained"] > 0.999 for r in line)
    far = whitening.whiten(vectors(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert [r["n"] for r in far] == [3] * 3


def test_factors_of_many_tasks_are_joined(spark, data):
    docs = spark.read.parquet(f"{data}/embeddings.parquet").repartition(50)
    rows = whitening.whole_numbers(docs)
    fit = whitening.fit_whitening(rows, 64)
    x = np.array([r["x"] for r in rows.collect()], dtype=float)
    c = x - x.mean(axis=0)
    e = np.linalg.eigvalsh(c.T @ c / len(x))[::-1]
    assert np.allclose(fit.variances, e[:len(fit.variances)], rtol=1e-10) and fit.n == len(x)


@pytest.mark.parametrize("shape", ["random", "equal", "multiple", "graded", "flat", "one", "chain"])
def test_bidiagonal_solver(shape):
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    a = {"random": draw.standard_normal((300, 40)), "equal": np.vstack([np.eye(40), -np.eye(40)]),
         "multiple": (np.vstack([np.eye(40), -np.eye(40)]) * np.repeat([1.0, 2, 3, 4], 10)) @ turn,
         "graded": draw.standard_normal((300, 40)) * 10.0 ** (-np.arange(40) / 5), "flat": np.repeat(draw.standard_normal((300, 4)), 10, axis=1),
         "one": draw.standard_normal((9, 1)), "chain": np.diag(np.ones(40)) + np.diag(np.ones(39), 1)}[shape]
    r = np.linalg.qr(a, mode="r")
    squares, directions, total = bidiagonal.largest_directions(r, 40)
    exact = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(squares, exact[:len(squares)], rtol=1e-11) and abs(total - exact.sum()) < 1e-9 * total
    assert len(squares) == min(40, a.shape[1], (exact > 1e-12 * exact[0]).sum())
    w = a @ directions / np.sqrt(squares)
    assert np.abs(w.T @ w - np.eye(len(squares))).max() < 1e-6 and np.abs(directions.T @ directions - np.eye(len(squares))).max() < 1e-10


# --- pages ----------------------------------------------------------------

P = "The harbour was busy, and boats came in from the north, carrying fish, rope and news of the storm."
Q = "Nobody on the quay had expected so many of them, least of all the clerk, who counted twice."
PAGES = {
    "furniture by name": (f'<body><div id="header"><h1>Site</h1></div><div class="menu"><ul><li><a>One</a><li><a>Two</a></ul></div><div><div class="content">'
                          f'<h1>Title &eacute;</h1><p>{P}</p><p>Short.</p><div class="ad">Buy, buy, buy, now, it is cheap, it is good.</div><p>{Q}</p>'
                          f'<ul><li>first</li><li>second</li></ul></div><div class="sidebar"><p>{P} {Q}</p></div></div><div id="comments"><p>{P}</p>'
                          f"<p>{Q} {P}</p></div><footer>{P}</footer></body>", ["Title é", P, "Short.", Q, "first", "second"]),
    "sections": (f"<main><section><h2>A</h2><p>{P}</p></section><section><h2>B</h2><p>{Q}</p></section></main>", ["A", P, "B", Q]),
    "siblings": (f'<h1>Head</h1><div class="part"><p>{P}</p><p>{Q}</p></div><div class="part"><p>{Q}</p><p>{P}</p></div><p><a>more links</a></p>',
                 ["Head", P, Q, Q, P]),
    "tags left open": (f"<p>{P}<p>{Q}", [P, Q]),
    "no markup": ("just text &amp; more &lt;b> &am; a < b", ["just text & more <b> &am; a < b"]),
    "lines": (f"<div>{P}<br><br>{Q}</div><div>tiny</div>", [f"{P} {Q}"]),
    "many links": (f"<div><p>{P}</p><p>{Q}</p></div><div>" + f"<p><a href=x>{Q}</a></p>" * 9 + "</div>", [P, Q]),
    "no text": ("<html><body></body></html>", []),
    "script": ('<script>var a="<p>x</p>";', []),
    "comment": (f"<!-- <p>{P}</p> --><p>{Q}</p><!-- open", [Q]),
    "reader comments": (f'<article><h1>T</h1><p>{P}</p><section class="comments"><article class="comment"><p>{Q} {Q}</p></article></section>'
                        f"<form><p>{P}</p></form></article>", ["T", P]),
    "notice": (f'<div class="cookie-notice"><p>{P} {P} {P}</p></div><article><p>Short one.</p></article>', ["Short one."]),
    "white space": (f"<article><pre>a\n  b</pre><p> {P}\t\n x</p></article>", ["a b", f"{P} x"]),
    "attributes": (f'<article><p title="a > b" class=\'x\'>{P}</p><p>{Q}</p></article>', [P, Q]),
}


@pytest.mark.parametrize("kind", PAGES)
def test_main_text(kind):
    html, blocks = PAGES[kind]
    assert main_text(html) == "\n\n".join(blocks)


def test_long_and_damaged_pages_take_linear_time():
    assert main_text(None) == main_text("") == ""
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert main_text(long).count(P) == 20_000
    for bad in ("<" * 200_000, "<!--" * 100_000, "<a " * 100_000, "<a '>" * 99_999, "&" * 200_000, "<div>" * 50_000 + P, "</i>" * 100_000):
        main_text(bad)


def test_every_page_has_a_row(spark):
    rows = [(1, "u", PAGES["sections"][0], "t", 5), (1, "u", PAGES["sections"][0], "t", 5), (2, None, None, "t", 5), (None, "v", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract_text(pages)
    text = "\n\n".join(PAGES["sections"][1])
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == sorted([(1, text, len(text))] * 2 + [(2, "", 0), (0, "", 0)])
    assert extract_text(pages.limit(0)).collect() == []


# --- spelling -------------------------------------------------------------

DOCS = "doc_id long, text string, word string, n long, box int, letters string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "l") for i, t in rows], DOCS)


def plain_words(rows):
    counts, small = Counter(), {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(small)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            run = run[:at] + run[at + 1:] if h % 31 == 0 else run
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(n):
    near, blanked = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            blanked[w[:i] + "\0" + w[i + 1:]].append(w)
            if (short := w[:i] + w[i + 1:]) in n:
                near[w].add(short)
                near[short].add(w)
    for words in blanked.values():
        for a in words:
            near[a].update(b for b in words if b != a)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_documents(spark, data):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "Überall überall ÜBERALL ÷×÷×÷×÷ " * 3), (9, None), (10, ""), (11, "   "), rows[0], rows[0], (12, "z" * 30_000 + " " + "z" * 30_000)]
    want = plain_variants(plain_words(rows))
    assert rows_of(spelling.spelling_variants(documents(spark, rows))) == want and any(r[1] for r in want)
    assert rows_of(spelling.spelling_variants(documents(spark, []))) == []


@pytest.mark.parametrize(("room", "bucket"), [(16_384, 32), (5, 2)])
def test_all_pairs_are_found_whatever_the_boxes(spark, monkeypatch, room, bucket):
    """Few letters, so that many words share their letter counts; boxes of five words; chains of forms; equal n."""
    draw = random.Random(room)
    monkeypatch.setattr(spelling, "BOX_WORDS", room)
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    n = {}
    while len(n) < 700:
        w = "".join(draw.choice("abé") for _ in range(draw.randrange(7, 10)))
        n[w] = draw.choice([2, 2, 2, 20, 21, 200, 2000, 20_000])
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    if room == 5:  # constants of the module do not reach the workers, so only the upper trees are cut finer
        trees = spelling.upper_trees(words.selectExpr("word", "n", "length(word) size", "encode(word, 'ISO-8859-1') letters"))
        assert sum(t.boxes for t, _ in trees.values()) > 50
    assert rows_of(spelling.group_variants(words)) == plain_variants(n)


def test_reach_finds_every_box_one_edit_away():
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abcd") for _ in range(7)) for _ in range(500)})
    letters = np.frombuffer("".join(words).encode(), dtype=np.uint8).reshape(-1, 7)
    x = kdtree.points(letters)
    tree, box = kdtree.build(x, np.ones(len(x)), 4)
    rows, boxes = kdtree.reach(tree, x, True)
    found = set(zip(rows.tolist(), boxes.tolist(), strict=True))
    for i in range(len(x)):
        for j in range(len(x)):
            d = x[j] - x[i]
            if np.abs(d).sum() == 2 and d.argmax() < d.argmin():
                assert (i, int(box[j])) in found
    assert len(found) == len(rows) < len(x) * tree.boxes / 2


def test_a_crowded_box_is_dealt_over_parts(spark, monkeypatch):
    """All words have the same letters, so no tree can cut them."""
    monkeypatch.setattr(spelling, "BOX_WORDS", 10)
    draw = random.Random(2)
    same = {"".join(draw.sample("abcdefg", 7)) for _ in range(300)}
    n = {w: 2 for w in same} | {w[:3] + "z" + w[4:]: 30 for w in list(same)[:100]} | {w[:5] + w[6:] + "aa": 50 for w in list(same)[:40]}
    n |= {w + "q": 500 for w in list(same)[:60]}
    assert rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)
