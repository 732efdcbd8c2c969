"""Rows that repeat a key, columns that clash, hot groups, several blocks, and the pipeline on odd rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from launchgrid.llm import huffman, minhash, packing, sentence_spans, suffixes, vocab
from tokenizers import Tokenizer

rnd = random.Random(9)
DOCS = "doc_id bigint, text string"


def words(kind, n):
    return " ".join(f"{kind}{rnd.randrange(500)}" for _ in range(n))


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_versions_of_a_document_share_links(spark, parts):
    a, b = words("a", 60), words("b", 60)
    rows = [(3, a), (3, b), (7, a + " z"), (8, b + " z"), (9, words("c", 60)), (None, b), (3, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (3, 3), (3, 3), (7, 3), (8, 3), (9, 9)]
    assert len({r.doc_id for r in got if not r.kept} & {7, 8}) == 2


def test_keep_one_keeps_rows_without_a_key(spark):
    a, b = words("a", 30), words("b", 30)
    rows = [(None, a, 1, 1), (None, a, 1, 1), (1, b, 1, 1), (1, b, 1, 1), (1, b + " end", 2, 2), (2, b + " x", 1, 1), (3, None, 1, 1), (4, "", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int, m int").repartition(3)
    out = minhash.keep_one(docs, 80)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(0, a), (0, a), (1, b), (1, b + " end"), (3, ""), (4, "")])


@pytest.mark.parametrize("layout", ["one", "apart", "many"])
def test_repeats_do_not_depend_on_partitions(spark, layout):
    passage = words("p", 60)
    rows = [(5, f"one {passage} x"), (5, f"two {passage} y"), (1, f"first {passage}"), (9, words("q", 40))]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    if layout == "apart":  # both versions in one task, the first document in another
        docs = docs.where("doc_id = 5").coalesce(1).union(docs.where("doc_id <> 5").coalesce(1))
    elif layout == "many":
        docs = docs.repartition(4)
    got = sorted((r.doc_id, r.n_removed) for r in suffixes.remove_repeats(docs, digests=True).collect())
    gone = len(passage) + 1  # with the space before it
    assert got == [(1, 0), (5, gone), (5, gone), (9, 0)]


def test_texts_longer_than_a_buffer(spark, monkeypatch):
    long = " ".join(words("l", 400) for _ in range(400))
    assert len(long) > suffixes.BUFFER + 6000
    rows = [(1, long), (2, "before " + long[suffixes.BUFFER - 5000: suffixes.BUFFER + 5000] + " after"), (3, long)]
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(2), digests=True).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 10_000 and (got[3].n_removed, got[3].n_spans) == (len(long), 1)


def test_words_whose_small_letters_end_in_a_mark(spark):
    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 0)):
        tok, enc = Tokenizer.from_file(P.path(name)), vocab.json_encoder(P.path(name))
        odd = ["HAL\u0130.", "\u0130!", "a\u0130b, c", "Stra\u00dfe.", "\ufb01n.", "don't.", "x.y", "3,5.", "\u01c5!?", "O\u0308l.", "i\u0307."]
        odd += ["".join(rnd.choice(["\u0130", "a", "B", ".", "!", " ", "\u0307", "\u00df", "'", "\n", "1", "\u1e9e"]) for _ in range(rnd.randrange(12))) for _ in range(1500)]
        got = enc.encode(odd)
        for t, g in zip(odd, got):
            assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, (name, t)


def test_small_caches_change_nothing(monkeypatch):
    tok, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), vocab.json_encoder(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(vocab, "CACHE_BYTES", 2000)
    for _ in range(20):
        texts = [words("w", 30) + ". " + "y" * rnd.randrange(90) for _ in range(5)]
        assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_rows_go_to_many_groups(spark):
    rows = [(1, "the same text of a few words")] * 3000 + [(2, "another")]
    out = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), P.path("word_bpe_49k.json"), group=300).collect()
    sizes = collections.Counter(r.sequence_id >> 32 for r in out)
    assert len(out) == 3001 and len(sizes) >= 9 and max(sizes.values()) < 500


def test_several_blocks_and_checkpoints(spark, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(huffman, "BLOCK", 700)
    rows = [(i, words("w", rnd.choice([0, 1, 40, 600]))) for i in range(60)]
    want, start = [], 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, huffman.round_trip(spark.createDataFrame(rows, DOCS).repartition(4), path).collect())) == want


def test_sentence_spans_against_all_runs(spark):
    """Every shortest run of pieces from and up to each piece, compared as words, not by hash."""
    bank = [words("s", rnd.randrange(3, 30)) + rnd.choice([".", "!", ""]) + "\n" for _ in range(12)]
    rows = [(i, "".join(rnd.choice(bank) for _ in range(rnd.randrange(0, 9)))) for i in range(40)]
    cut, found = {}, []
    for i, t in rows:
        ends, upto, _ = sentence_spans.pieces(t)
        ws, ends, upto = t.split(), ends.tolist(), [0, *upto.tolist()]
        cut[i] = [t[a:b] for a, b in zip([0, *ends], ends)]
        spans = set()
        for x in range(len(ends)):
            fit = [(x, y) for y in range(x + 1, len(ends)) if upto[y + 1] - upto[x] >= sentence_spans.WORDS]
            spans.update(fit[:1])
            fit = [(y, x) for y in range(x) if upto[x + 1] - upto[y] >= sentence_spans.WORDS]
            spans.update(fit[-1:])
        found += [((b - a, *ws[upto[a]: upto[b + 1]]), i, a, b) for a, b in spans]
    first = {}
    for run, i, a, b in sorted(found):
        first.setdefault(run, (i, a))
    gone = collections.defaultdict(set)
    for run, i, a, b in found:
        if (i, a) != first[run]:
            gone[i].update(range(a, b + 1))
    got = {r.doc_id: r for r in sentence_spans.remove_spans(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    for i, t in rows:
        assert (got[i].n_sentences, got[i].n_removed) == (len(cut[i]), len(gone[i])), i
        assert got[i].text == "".join(p for k, p in enumerate(cut[i]) if k not in gone[i])
    assert sum(map(len, gone.values())) > 20


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    a = words("a", 60)
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, a, None, None, None), (3, a, "en", "s", 1), (4, a + " b", "en", "s", 1), (None, a, "x", "y", 2)]
    for odd in (rows, []):
        docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(packed) == docs.count() == (len(odd) and 6 - 1)
