"""Small cases of every training-data operator against brute force, with nulls, ties, repeats and clashes."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from launchgrid.llm import bpe, huffman, minhash, near_vectors, packing, sentence_spans, suffixes, tokens, toxicity, tree_search, vocab
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORDS = "the of and to river stone house bright walk under seven it's don't Zürich naïve 12 3.5 --- a b c".split()
rnd = random.Random(3)


def prose(n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", "!", ","]) for _ in range(n))


BASE = prose(300)
ODD = ["", None, " ", "\n\n a  b \t", "<|endoftext|> x<s>", "▁x ▁", "é́ 中文 😀", "a\x00b", BASE, BASE, BASE.replace("river", "brook", 1),
       "x" * 3000, prose(4000), "One. " + BASE, BASE + " Two."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "l", "s", 1, "clash", b"x") for i, t in enumerate(ODD)] + [(7, "a\x00b", None, None, None, None, None), (None, BASE, "l", "s", 1, "c", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids binary").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_counts(docs, none):
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path, 50).collect())
    assert got == sorted((str(i), len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 50) for i, t in texts(docs))
    assert tokens.token_counts(none, path).count() == 0


def test_bpe_round_trip(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.read_ranks(path), special_tokens={})
    rows = bpe.digests(bpe.decode(bpe.encode(docs, path, P.PATTERN), path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(
        (str(i), sha(" ".join(map(str, enc.encode_ordinary(t))).encode()), sha(t.encode())) for i, t in texts(docs))
    assert bpe.encode(none, path, P.PATTERN).count() == 0
    spans = bpe.spans(path, P.PATTERN, ODD[6])
    assert b"".join(ODD[6].encode()[s[3]:s[4]] for s in spans) == ODD[6].encode()
    assert "".join(bpe.decode_slices(path, [[s[0]] for s in spans])) == ODD[6]


def test_files_round_trip(docs, none):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, len(tok.encode(x[1]).ids))):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, huffman.round_trip(docs, path).collect()), key=lambda r: r[1]) == want
    assert huffman.round_trip(none, path).count() == 0


@pytest.mark.parametrize("counts", [[5], [0, 1], [1, 1, 1], [2**i for i in range(40)]])
def test_code_lengths(counts):
    bits = huffman.code_lengths(np.array(counts), 18)
    assert bits.max() <= 18 and sum(2.0**-int(b) for b in bits if b) <= 1
    ids = np.repeat(np.flatnonzero(counts), 7)
    data, marks = huffman.pack(ids, huffman.codes_of(bits), bits)
    assert (huffman.Table(bits).unpack(data, len(ids), marks) == ids).all()


def test_packing(docs, none):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, group=5).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [n for _, n in spans[:-1]])) and sum(n for _, n in spans) <= 2048
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in texts(docs)}
    assert collections.Counter(r.doc_id for r in rows if r.start == 0) == collections.Counter(i for i, _ in texts(docs))
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert packing.pack(none, path).count() == 0


def test_first_fit_decreasing_is_plain_first_fit():
    sizes = [rnd.randint(1, 2048) for _ in range(500)]
    room, want = [], [0] * len(sizes)
    for i in sorted(range(500), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(2048)
        room[b] -= sizes[i]
        want[i] = b
    assert packing.first_fit_decreasing(sizes)[0] == want


def vectors(spark):
    g = np.random.default_rng(2)
    x = g.standard_normal((300, 8)).astype("float32")
    x[50:80] = x[50] + 0.02 * g.standard_normal((30, 8)).astype("float32")
    x[90:95] = x[90]
    rows = [(i, [float(v) for v in r], i % 2 if i % 50 else None) for i, r in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, [], 0), (None, [1.0] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3), x


def test_tree_search(spark):
    table, x = vectors(spark)
    rows = tree_search.search(table, table.where("vec_id % 20 = 0"), 5).collect()
    y, hit = x.astype(float), 0
    for q in range(0, 300, 20):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - y[q] @ y[r.vec_id]) < 1e-9 for r in mine) and mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in mine} & set([i for i in np.argsort(-(y @ y[q]), kind="stable") if i != q][:5]))
    assert hit >= 0.9 * 75 and {r.query_id for r in rows} == set(range(0, 300, 20))
    assert tree_search.search(table.where("false"), table, 5).count() == 0


def test_near_vectors(spark):
    table, x = vectors(spark)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(table, 0.98).collect()}
    assert len(got) == 306
    link = (y @ y.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300)[None, :] % 2) & ~np.eye(300, dtype=bool)
    link[np.arange(300) % 50 == 0] = link[:, np.arange(300) % 50 == 0] = False
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(link, comp[None, :], 999).min(1))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert got[301].n_links == 0 and got[301].kept and got[None].kept
    assert near_vectors.near_duplicates(table.where("false")).count() == 0


def test_near_vectors_of_several_dimensions(spark):
    rows = [(i, [1.0, 0.5, i / 1000] if i < 6 else [1.0, 0.5, 0.2, i / 1000], 1) for i in range(15)]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(2), 0.98).collect()}
    assert all((got[i].n_links, got[i].component_id) == ((5, 0) if i < 6 else (8, 6)) for i in range(15))


def test_toxicity(spark, docs, none):
    rows = [(i, prose(40) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(table.drop("toxic"), model).collect()}
    assert all(got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, y in rows)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.keep_clean(docs, model).schema == docs.schema and toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.score(none, toxicity.train(none, table.select("doc_id", "toxic").where("false"))).count() == 0


def test_toxicity_learns_from_the_ends_of_long_texts(spark):
    clean = [" ".join(f"c{rnd.randrange(3000)}" for _ in range(4500)) for _ in range(120)]  # over 20,000 characters
    assert min(map(len, clean)) > 20_000
    table = spark.createDataFrame([(i, t + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(clean)], "doc_id bigint, text string, toxic int").repartition(3)
    model = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"))
    assert model.weights.get(toxicity.bucket("vile"), 0) > 0


def test_distinct_drops_near_copies_only():
    g = random.Random(5)
    common = "as well as of the in the"  # word pairs that all texts share
    texts = [" ".join(f"w{g.randrange(5000)}" for _ in range(60)) + f" {common} " + " ".join(f"w{g.randrange(5000)}" for _ in range(60)) for _ in range(300)]
    assert len(toxicity.distinct([toxicity.example(t) for t in texts])) == 300
    copies = [texts[0], texts[1].replace(common, "as well as"), "  ".join(texts[2].split()), texts[3] + " end"]
    assert len(toxicity.distinct([toxicity.example(t) for t in [*texts, *copies, "", " ", "one", "one", "two"]])) == 303


def near_brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp, sets


def test_minhash(docs, none):
    rows = [x for x in texts(docs) if x[0] is not None]
    comp, sets = near_brute(rows, 85)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    kept = minhash.keep_one(docs, 85)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in comp if comp[i] == i)
    assert minhash.near_duplicates(none).count() == 0


def test_block_links_reach_fringe_copies(spark):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a chain: each differs a little from the one before
        rows.append((i, " ".join(words)))
        words[(i * 2) % 120] = f"n{i}"
    comp, _ = near_brute(rows, 80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_suffixes(docs, none):
    rows = [(i, t.encode()) for i, t in texts(docs) if i is not None]
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p: p + 50], i)
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p: p + 50]] < i:
                gone[p: p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[i] = (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    got = suffixes.remove_repeats(docs, digests=True).collect()
    assert len(got) == docs.count()
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None) and [r.n_removed for r in got if r.doc_id is None] == [0]
    whole = suffixes.remove_repeats(docs)
    assert whole.columns == docs.columns and whole.count() == docs.count() and whole.where("text is null").count() == 1
    assert suffixes.remove_repeats(none, digests=True).count() == 0


def test_multikey_order_and_passes(monkeypatch):
    g = np.random.default_rng(4)
    w = g.integers(0, 3, (500, 4)).astype(np.uint64)
    order, run = suffixes.multikey_order(w)
    rows = [tuple(x) for x in w[order].tolist()]
    assert rows == sorted(rows) and run.tolist() == np.cumsum([0] + [a != b for a, b in zip(rows[1:], rows)]).tolist()
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    args = (np.array([1, 2, 3]), data, np.array([0, 80, 160]), np.array([20, 20, 20]))
    one = set(zip(*map(np.ndarray.tolist, suffixes.covered(*args))))
    monkeypatch.setattr(suffixes, "SUFFIXES", 4)
    assert one == set(zip(*map(np.ndarray.tolist, suffixes.covered(*args)))) and len(one) == 40


def test_sentence_spans(spark, docs, none):
    passage = "The first part has some words in it. The second part has a few more words. A third one ends."
    rows = [(1, f"Alone here at last. {passage} Then more."), (2, f"Other start of text.\n{passage}\nOther end."), (3, "No copy. Not here."), (4, None)]
    got = {r.doc_id: r for r in sentence_spans.remove_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1] and got[3].n_removed == 0 and got[4].text == ""
    assert (got[2].n_removed, got[2].n_spans, got[2].text) == (3, 1, "Other start of text.\nOther end.")
    assert sentence_spans.remove_spans(docs).count() == docs.count() and sentence_spans.remove_spans(none).count() == 0


def test_sentence_spans_without_sentence_ends(spark):
    word = lambda kind, n: " ".join(f"{kind}{i}" for i in range(n))
    passage = word("p", 60)
    rows = [(1, f"{word('a', 40)} {passage} {word('b', 40)}"), (2, f"{word('c', 33)}\u3000{passage}  {word('d', 25)}"), (3, word("e", 160)), (4, word("e", 160)),
            (5, f"Before it. {word('e', 160)}. After it."), (6, word("f", 19)), (7, word("f", 19)), (8, "One\n" + word("g", 30))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in sentence_spans.remove_spans(table).collect()}
    assert all(got[i].text == t and got[i].n_removed == 0 for i, t in rows if i in (1, 3, 6, 7, 8))
    left = got[2].text.split()
    assert sum(w[0] == "p" for w in left) <= 60 - sentence_spans.WORDS and [w for w in left if w[0] != "p"] == [w for w in rows[1][1].split() if w[0] != "p"]
    assert (got[4].text, got[4].n_spans, got[4].n_removed) == ("", 1, got[4].n_sentences)
    assert got[5].text.startswith("Before it. ") and got[5].text.endswith("After it.") and len(got[5].text.split()) <= 4 + 2 * sentence_spans.WINDOW


def test_pieces_hold_a_run_of_every_fifty_words():
    for _ in range(200):
        core = [f"w{rnd.randrange(400)}" for _ in range(5 * sentence_spans.WINDOW + sentence_spans.WORDS)]
        sides = [[" ".join(f"{k}{rnd.randrange(400)}" for _ in range(rnd.randrange(30))) for _ in range(2)] for k in "ab"]
        one, two = (set(sentence_spans.runs(f"{x} {' '.join(core)} {y}")[0].tolist()) for x, y in sides)
        assert one & two
    assert len(sentence_spans.pieces("z " * 100)[0]) <= 100 and sentence_spans.pieces("")[0].tolist() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids.append(set(r.doc_id for r in docs.collect()))
    assert ids[3] == ids[2] < ids[1] <= ids[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select(F.sum("length")).first() == packed.where("start = 0").select(F.sum("doc_tokens")).first()
