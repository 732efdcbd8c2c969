"""Phrases, page texts and vector codes against brute force and hand-made pages."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from launchgrid.llm import collocations, html_text, vector_codes

rnd = random.Random(11)
WORDS = "the of a river Stone house brightest é中 x\x00y walk".split(" ")


def prose(n):
    return "".join(rnd.choice(WORDS[:3] if rnd.random() < 0.6 else WORDS) + rnd.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(n))


def phrases_of(texts, most, least, keep, top):
    """Plain counting of all phrases; (lang, rank, phrase, a, l, r, n, score)."""
    f, n, out = collections.Counter(), collections.Counter(), []
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, most + 1):
                f.update((lang, *ws[i: i + k]) for i in range(len(ws) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i: i + k]) for p, a in cand.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1)
            if 100 * a >= keep * f[(p[0], *p[i: i + k])]}
    for lang in n:
        rows = []
        for p, a in cand.items():
            if p[0] == lang and p not in gone:
                s, k = min((1000000 * a * a // (f[p[: k + 1]] * f[(lang, *p[k + 1:])]), k) for k in range(1, len(p) - 1))
                rows.append((-s, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1:])]))
        out += [(lang, i + 1, t.decode(), -a, l, r, n[lang], -s) for i, (s, a, t, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    long = "river stone " * 400
    texts = [(rnd.choice(["en", "fr", None, ""]), prose(rnd.choice([0, 1, 2, 3, 50, 400]))) for _ in range(120)]
    texts += [("en", None), ("en", ""), (None, "..,,\n\n"), ("en", long), ("en", long), ("de", "x" * 5000)]
    docs = spark.createDataFrame([(i, t, l, 1, "c", 2) for i, (l, t) in enumerate(texts)], "doc_id int, text string, lang string, f int, phrase string, box int").repartition(5)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    read = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert read(collocations.collocations(docs, top=40)) == phrases_of(texts, 3, 10, 50, 40)
    assert collocations.collocations(docs.where("false")).count() == 0
    # Small flushes, many boxes, and every box of several pairs dealt out again by whole phrases.
    for name, value in (("FLUSH", 300), ("BOX_BYTES", 3000), ("HEAVY", 60)):
        monkeypatch.setattr(collocations, name, value)
    assert read(collocations.collocations(docs, most=4, least=5, keep=80)) == phrases_of(texts, 4, 5, 80, 2000)


@pytest.mark.parametrize("chunk", [40, 64, 10**6])
def test_long_pieces_are_cut_between_words(monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    for text in [" ".join(rnd.choice("abc") for _ in range(300)), prose(100), "y" * 200, " " * 200, "a " + "z" * 100 + " b c d e " * 9, "\n" * 99, ""]:
        got = collections.Counter()
        for words, again in collocations.word_chunks(text.encode(), 3):
            words = [w for w in words if w] + [b"\n"] * (not again)
            for i in range(len(words) - again):
                s = tuple(itertools.takewhile(lambda w: w != b"\n", words[i: i + 3]))
                got[s] += bool(s)
        want = collections.Counter()
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = [w.encode() for w in re.split("[ \t]+", piece) if w]
            want.update(tuple(ws[i: i + 3]) for i in range(len(ws)))
        assert +got == want


def test_partitions_of_a_sort_are_counts():
    r = np.random.default_rng(0)
    keys = np.minimum(r.zipf(1.3, (5000, 3)) - 1, 200).astype(np.int32)  # 0 ends a suffix
    keys[keys[:, 0] == 0] = 0
    keys[keys[:, 1] == 0, 2] = 0
    weight = r.integers(1, 5, len(keys))
    want = collections.Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 4):
            if k[d - 1]:
                want[tuple(k[:d])] += w
    got = [(tuple(keys[b, :a].tolist()), c) for d, row, n in collocations.three_way(keys, weight, 10) for a, b, c in zip(d.tolist(), row.tolist(), n.tolist())]
    assert sorted(got) == sorted((k, v) for k, v in want.items() if v >= 10)


SENTENCES = ["The river rose during the night and reached the old stone bridge before dawn.", "Nobody in the village had seen so much water since the winter of the great storm.",
             "By noon the council had closed the road, and two boats carried people to the school.", "Yes."]
PARAGRAPHS = "".join(f"<p>{s}</p>" for s in SENTENCES)
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul>'
PAGES = {
    "plain": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article><h1>Flood</h1>{PARAGRAPHS}</article><footer>&copy; 2020 The River</footer></body></html>",
              ["Flood", *SENTENCES]),
    "no article tag": (f'<body><div id="header">The River Daily</div><div class="menu">{MENU}</div><div id="content">{PARAGRAPHS}</div><div class="sidebar"><h3>Most read</h3>{MENU}</div>'
                       f'<div id="footer">All rights reserved.</div></body>', SENTENCES),
    "no names at all": (f"<body>{MENU}<div><div>{PARAGRAPHS}</div></div>{MENU}</body>", SENTENCES),
    "comments within": (f'<article>{PARAGRAPHS}<section class="comments"><h2>2 comments</h2><p>I was there too, and it was much worse than they say here.</p><form><p>Your name</p></form></section></article>', SENTENCES),
    "comments as articles": (f'<main><article>{PARAGRAPHS}</article><div id="comments"><article class="comment"><p>I was there too, and it was much worse than they say here.</p></article></div></main>', SENTENCES),
    "comments by title": (f"<body><article>{PARAGRAPHS}<section><h3>Kommentare</h3><p>I was there too, and it was much worse than they say here.</p></section></article></body>", SENTENCES),
    "notice and adverts": (f'<body><div class="cookie-notice">We use cookies to make this site better for you.</div><article><p>{SENTENCES[0]}</p><div class="ad">Buy two boats and get a third boat for free today.</div>'
                           f'<p>{SENTENCES[1]}</p><aside>Related: <a href="/x">the great storm</a></aside><p>{SENTENCES[2]}</p></article></body>', SENTENCES[:3]),
    "broken markup": (f'<body><nav>{MENU}</nav><article><p><b>{SENTENCES[0]}<br><p>{SENTENCES[1]}<p>{SENTENCES[2]}</article><footer>&copy; x', SENTENCES[:3]),
    "script with tags": (f'<article><script>var t="</p><article>";</script><p>{SENTENCES[0]}</p><!-- <p>not me</p> --><style>a>b{{}}</style><p>{SENTENCES[1]}</p></article>', SENTENCES[:2]),
    "references": ("<article><p>Tom &amp; Ann &lt;3&gt; caf&eacute; &#8211; &#x41; in\n\t the   old&nbsp;<b>to</b>wn,<br>all the day long.</p></article>", ["Tom & Ann <3> café – A in the old town, all the day long."]),
    "form": (f'<article>{PARAGRAPHS}</article><form action="/s"><label>Search this site for old stories</label><input name="q"><button>Go</button></form>', SENTENCES),
    "article header": (f"<header><p>The River Daily</p></header><article><header><h1>Flood</h1></header>{PARAGRAPHS}</article>", ["Flood", *SENTENCES]),
    "wrapper names": (f'<body class="no-sidebar"><div class="row with-sidebar" data-hidden="no"><div class="post"><div class="entry-header"><h2>Flood</h2></div>{PARAGRAPHS}</div>'
                      f'<div class="widget-area">{MENU}</div></div><div class="reply-list"><p>I was there too, and it was worse.</p></div></body>', ["Flood", *SENTENCES]),
    "hidden": (f'<article>{PARAGRAPHS}<p hidden>Nobody shall ever read this long sentence here.</p><div style="display: none">Nor shall they read this one.</div></article>', SENTENCES),
    "empty": ("", []), "text alone": ("The river rose during the night and reached the old stone bridge before dawn.", [SENTENCES[0]]),
    "only a menu": (f"<body><nav>{MENU}</nav></body>", []), "odd": ("<<p>< a <b x='>'\"> </ <!-- <p", None), "null": (None, []),
}


def test_page_texts(spark):
    rows = [(i, f"http://u/{i}", html, "clash") for i, (html, _) in enumerate(PAGES.values())] + [(None, None, PAGES["plain"][0], "c"), (0, None, PAGES["plain"][0], "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_key = {(r.page_id, r.url): r.text for r in got}
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        if want is not None:
            assert by_key[i, f"http://u/{i}"] == "\n".join(want), name
    assert by_key[None, None] == by_key[0, None] == "\n".join(PAGES["plain"][1])
    assert html_text.extract(pages.where("false")).count() == 0


def test_long_and_deep_pages_end():
    many = "".join(f"<div><p>{SENTENCES[i % 3]}</p><a href='#'>more</a></div>" for i in range(5000))
    assert html_text.main_text(f"<article>{many}</article>").count("\n") >= 4999
    assert html_text.main_text("<div>" * 3000 + SENTENCES[0] + "</div>" * 3000) == SENTENCES[0]
    html_text.main_text('<a "' * 3000 + "<p>x")


def test_the_cut_is_minimal():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 8)
        score = [r.choice([-3, -2, -1, 0, 1, 2, 3]) * 1.0 for _ in range(n)]
        ties = [(a, b, r.choice([0.5, 1.0, 2.0])) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda keep: sum(-s if k and s < 0 else s if not k and s > 0 else 0 for s, k in zip(score, keep)) + sum(w for a, b, w in ties if keep[a] != keep[b])
        assert math.isclose(cost(html_text.min_cut(score, ties)), min(cost(k) for k in itertools.product([False, True], repeat=n)))


def codes_of(rows, parts, entries, rounds):
    """Plain Lloyd rounds; rows of (vec_id, label, whole numbers)."""
    width = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * width: (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(cut(r[2], p)) for r in first] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda: [[min((dist(cut(r[2], p), b), e) for e, b in enumerate(books[p])) for p in range(parts)] for r in rows]
    for _ in range(rounds):
        got = near()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(r[2], p) for r, g in zip(rows, got) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    got, sums = near(), collections.Counter()
    for r, g in zip(rows, got):
        sums[r[1]] += sum(d for d, _ in g)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g), sums[r[1]], sha) for r, g in zip(rows, got))


@pytest.mark.parametrize("n,spread", [(150, 1.0), (9, 1.0), (300, 0.001)])
def test_vector_codes(spark, n, spread):
    r = np.random.default_rng(n)
    vectors = [(r.normal(size=16) * spread).tolist() for _ in range(n)]
    vectors[3], vectors[-1] = vectors[2], [0.0] * 16
    rows = [(i, int(r.integers(0, 3)) or None, v) for i, v in enumerate(vectors)] + [(None, 1, vectors[0]), (2, None, vectors[4])]
    odd = [(900, 1, None), (901, 1, []), (902, 1, [None] * 16), (903, 1, [float("nan")] * 16), (904, 1, [float("inf")] + [0.0] * 15), (-5, 1, [1.0] * 7), (905, 1, [1.0] * 24)]
    table = spark.createDataFrame([(*x, "c", 1) for x in rows + odd], "vec_id bigint, label int, embedding array<double>, code string, error int").repartition(3)
    want = codes_of([(i, l, [math.floor(4096 * c) for c in v]) for i, l, v in rows], 8, 16, 6)
    got = sorted((str(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in vector_codes.compress(table).collect())
    assert got == want
    assert vector_codes.compress(table.where("false")).count() == 0


def test_only_moved_entries_matter():
    r = np.random.default_rng(2)
    x, books = r.integers(-3, 3, (500, 4, 2)), r.integers(-3, 3, (4, 6, 2))
    code, dist = vector_codes.assign(x, books, np.ones((4, 6), bool), np.zeros((500, 4), np.int64), np.zeros((500, 4), np.int64))
    for _ in range(20):
        new = books.copy()
        new[r.integers(0, 4, 3), r.integers(0, 6, 3)] = r.integers(-3, 3, (3, 2))
        again = vector_codes.assign(x, new, (new != books).any(2), code, dist)
        whole = vector_codes.assign(x, new, np.ones((4, 6), bool), code, dist)
        assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
        (code, dist), books = again, new
