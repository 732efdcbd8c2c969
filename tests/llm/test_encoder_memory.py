"""What a Python worker holds of the encoding step, and the cuts between chunks."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from launchgrid.llm import huffman, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_reading_blocks_gives_the_encoder_back():
    ids = np.frombuffer(vocab.json_encoder(PATH).encode(["one two three two"])[0], "<u4")
    assert vocab.json_encoder.cache_info().currsize == 1
    bits = huffman.code_lengths(np.bincount(ids))
    data, marks = huffman.pack(ids, huffman.codes_of(bits), bits)
    block = pa.RecordBatch.from_pylist([{"first": 3, "n_ids": len(ids), "doc_ids": [5, 6], "sizes": [1, len(ids) - 1], "bits": data,
                                         "checkpoints": marks.astype("<u8").tobytes(), "base": 10}])
    rows = [r for b in huffman.decode_blocks([block], bits, True) for r in b.to_pylist()]
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(5, 13, 1), (6, 14, len(ids) - 1)]
    assert b"".join(r["ids"] for r in rows) == ids.tobytes()
    assert vocab.json_encoder.cache_info().currsize == 0


@pytest.mark.parametrize("alphabet", ["ab \n", "ab \n\t\x1c\x0b", "aé\x85\xa0 　 \n", "😀 \n "])
def test_single_gaps_are_those_of_a_plain_split(alphabet):
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(8)))
        assert vocab.single_gaps(t) == (t.split() == t.replace("\n", " ").split(" ")), repr(t)


class Asked(dict):
    """A cache that counts how often it is asked."""

    n = 0

    def get(self, key, other=None):
        self.n += 1
        return super().get(key, other)


def test_the_cache_is_asked_once_per_distinct_chunk(spark, monkeypatch):
    enc = vocab.Encoder(vocab.json_encoder(PATH).tokenizer, vocab.cut_bytes, letters=True)
    enc.known = Asked()
    monkeypatch.setattr(huffman, "json_encoder", lambda path: enc)
    monkeypatch.setattr(huffman, "ship", lambda spark: None)
    taken = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: taken.append(run) or df, raising=False)
    huffman.encode_ids(spark.createDataFrame([(1, "")], "doc_id long, text string"), PATH, 0)
    texts = [" ".join(["one", "two", "thrée", "four."] * 500)] * 3 + ["", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = [r for b in taken[0]([batch]) for r in b.to_pylist()]
    plain = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in rows[:5]] == plain and [r["n_tokens"] for r in rows[:5]] == [len(x) for x in plain]
    used, n = np.frombuffer(rows[5]["counts"], np.int64).reshape(2, -1)
    assert dict(zip(used.tolist(), n.tolist())) == {i: sum(x.count(i) for x in plain) for x in plain for i in x}
    assert enc.known.n <= 20  # 6,001 chunks, few of them distinct


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cache", [vocab.CACHE_BYTES, 2000])
def test_a_column_has_the_ids_of_its_whole_texts(monkeypatch, name, cache):
    monkeypatch.setattr(vocab, "CACHE_BYTES", cache)
    enc, rng = vocab.json_encoder(public_tokenizers.path(name)), random.Random(7)
    alphabet = ["a", "b", "Z", "é", "ñ", "ß", "ª", "µ", "ſ", "ǅ", "ɐ", "́", "д", "語", "1", ".", "'s", "'", " ", " ", " ", "\n", "\t", "\x00", "\xa0", "<|endoftext|>", "😀", "x" * 60]
    assert [x.tolist() for x in enc.encode_column([])] == [[], []]
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 9))]
        ids, sizes = enc.encode_column(texts)
        plain = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(x) for x in plain] and ids.tolist() == sum(plain, []), texts
