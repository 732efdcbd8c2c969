"""Phrases that occur more often than their parts suggest, from sorted suffixes of word sequences.

Tasks first add up equal suffixes of their own texts. These travel to boxes by their two leading
words; there suffix pointers are sorted by multikey quicksort to the longest phrase, the size of a
partition of equal words is the count of a phrase, and partitions that are too small are abandoned.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.llm.common import discard, durable, mix, ship, slices, tasks

MOST, LEAST, KEEP, TOP = 3, 10, 50, 2000
FLUSH = 2_000_000         # words of a task's texts that are counted before they travel
CHUNK = 2 << 20           # bytes of text split into words at a time
BOX_BYTES = 8 << 20       # text whose suffixes go to one box
HEAVY = 2_000_000         # suffixes in a box beyond which it is dealt out again by whole phrases
_SAME = bytes.maketrans(b"\t.,;:!?\x0a\x0b\x0c\x0d", b" " + b"\n" * 10)  # fixed values: what parts words and pieces


def _shrink(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 1)


def _grow(b: bytes):
    return pickle.loads(zstandard.decompress(b))


class _Ids(dict):
    """Words to running numbers; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_chunks(data: bytes, most: int):
    """(words and b"\\n" for the end of a piece, how many words at the end do not begin a suffix here).

    Data is cut at ends of pieces; a piece longer than CHUNK is cut between words, and the next chunk
    begins ``most`` - 1 words before.
    """
    data = data.translate(_SAME)
    at = 0
    while len(data) - at > CHUNK:
        end = data.rfind(b"\n", at + 1, at + CHUNK)
        again = 0
        if end < 0:
            end = data.rfind(b" ", at + 1, at + CHUNK)
            tail = data[at: max(end, at)].rsplit(None, most - 1)
            if end < 0 or len(tail) < most:  # hardly any words: to the next end of a piece
                end = data.find(b"\n", at + 1)
                end = len(data) if end < 0 else end
            else:
                again = most - 1
        part = data[at:end]
        yield part.replace(b"\n", b" \n ").split(b" "), again
        at = end
        if again:  # back to the start of the first repeated word
            cut = part.rstrip()
            for _ in range(again):
                cut = cut[: cut.rfind(b" ")].rstrip()
            at -= len(part) - len(cut)
    yield data[at:].replace(b"\n", b" \n ").split(b" "), 0


def suffix_counts(ids: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of at most ``most`` words that begin at ``starts``, as rows of ids, and their counts."""
    rows = np.zeros((len(starts), most), np.int32)
    padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
    alive = np.ones(len(starts), bool)
    key, top = np.zeros(len(starts), np.int64), int(ids.max(initial=0)) + 1
    reach = 1
    for d in range(most):
        rows[:, d] = np.where(alive, padded[starts + d], 0)
        alive &= rows[:, d] > 0
        if reach * top >= 2**62:  # too many values for one number: number those that occur
            key = np.unique(key, return_inverse=True)[1]
            reach = len(key)
        key = key * top + rows[:, d]
        reach *= top
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return rows[first], n


def three_way(keys: np.ndarray, weight: np.ndarray, least: int):
    """Multikey three-way quicksort of row pointers; yields (depth, pointer, sum of weights) of partitions of equal prefixes.

    All open partitions are split around their own pivots at once: smaller, equal and larger words. The
    equal part goes on with the next word; its weight is the count of that prefix. Partitions lighter
    than ``least``, and those of prefixes that end (word 0), are abandoned.
    """
    n, width = keys.shape
    flat = np.ascontiguousarray(keys.T).reshape(-1)
    order, size, depth = np.arange(n, dtype=np.int32), np.array([n]), np.array([0])
    while size.sum():
        first = np.cumsum(size) - size
        word = flat[order + np.repeat(depth * n, size)]
        x, y, z = word[first], word[first + size // 2], word[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        at = np.repeat(np.arange(len(size), dtype=np.int32), size)
        go = []
        for side, mine in enumerate((word < pivot, word == pivot, word > pivot)):
            rows, of = order[mine], at[mine]
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
            total = np.add.reduceat(weight[rows], begin) if len(of) else np.zeros(0, np.int64)
            count, deep, live = np.diff(np.append(begin, len(of))), depth[of[begin]], total >= least
            if side == 1:
                live &= flat[rows[begin] + deep * n] > 0
                yield deep[live] + 1, rows[begin[live]], total[live]
                deep = deep + 1
                live &= deep < width
            go.append((rows[np.repeat(live, count)], count[live], deep[live]))
        order, size, depth = (np.concatenate(c) for c in zip(*go))


def _rows(cols: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _by(box: np.ndarray):
    order = np.argsort(box, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], box[order[1:]] != box[order[:-1]]])) if len(box) else []
    for a, b in zip(cut, [*cut[1:], len(box)]):
        yield int(box[order[a]]), order[a:b]


def _blob(words: list[bytes], rows: np.ndarray, n: np.ndarray) -> bytes:
    """Suffixes with only the words they use; id 0 is the end."""
    used, local = np.unique(rows, return_inverse=True)
    names = [words[i] for i in used.tolist() if i]
    local = local.reshape(rows.shape) + (0 if len(used) and used[0] == 0 else 1)
    return _shrink((b"\n".join(names), rows.shape[1], local.astype(np.uint32).T.tobytes(), n.astype(np.uint32 if n.max(initial=0) < 2**32 else np.uint64)))


def _open(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    names, width, rows, n = _grow(blob)
    return [b"", *names.split(b"\n")], np.frombuffer(rows, np.uint32).reshape(width, -1).T, n.astype(np.int64)


_SENT = "lang string, box bigint, n bigint, blob binary"
_SENT_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary()]


def sent_suffixes(src: DataFrame, boxes: int, most: int) -> DataFrame:
    """(lang, box, n, blob): counted suffixes by the hash of their two leading words, single words by their own."""
    def run(batches):
        ids: dict[str, _Ids] = {}
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                words = [b"", *list(ids[lang])[1:]]
                every = np.concatenate([p[0] for p in parts])
                at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
                starts = np.concatenate([np.flatnonzero(p[0][: len(p[0]) - p[1]] > 0) + a for p, a in zip(parts, at)])
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                single = np.bincount(every[starts], minlength=len(words))
                rows, n = suffix_counts(every, starts, most)
                more = rows[:, 1] > 0
                rows, n = rows[more], n[more]
                some = np.flatnonzero(single)
                out = [(lang, b, len(i), _blob(words, some[i][:, None], single[some[i]])) for b, i in _by((mix(hashes[some], 1) % np.uint64(boxes)).astype(np.int64))]
                box = mix(mix(hashes[rows[:, 0]], 2) + hashes[rows[:, 1]], 3) % np.uint64(boxes)
                out += [(lang, b, len(i), _blob(words, rows[i], n[i])) for b, i in _by(box.astype(np.int64))]
                for i in range(0, len(out), 64):
                    yield _rows(list(zip(*out[i: i + 64])), ["lang", "box", "n", "blob"], _SENT_KINDS)
            held.clear(), ids.clear()

        for batch in batches:
            for part in slices(batch, 256):
                texts: dict[str, list[bytes]] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(t.encode().lower())
                for lang, own in texts.items():
                    number = ids.setdefault(lang, _Ids({b"\n": 0}))
                    for words, again in word_chunks(b"\n".join(own), most):
                        words = list(filter(None, words))
                        got = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                        if not again:
                            got = np.append(got, np.int32(0))
                        held.setdefault(lang, []).append((got, again))
                        size += len(got)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return src.mapInArrow(run, _SENT)


def _dealt_again(sent: DataFrame, heavy: dict[int, int], boxes: int) -> DataFrame:
    """Suffixes of heavy boxes by the hash of all their words, so that no pair of words fills a box."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, box, n, blob = (batch.column(c)[i].as_py() for c in range(4))
                if box not in heavy:
                    yield batch.slice(i, 1)
                    continue
                words, rows, n = _open(blob)
                if rows.shape[1] == 1:
                    yield batch.slice(i, 1)
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                x = np.zeros(len(rows), np.uint64)
                for d in range(rows.shape[1]):
                    x = mix(x + h[rows[:, d]], 5)
                out = [(lang, boxes + box + boxes * k, len(j), _blob(words, rows[j], n[j])) for k, j in _by((x % np.uint64(heavy[box])).astype(np.int64))]
                yield _rows(list(zip(*out)), ["lang", "box", "n", "blob"], _SENT_KINDS)

    return sent.mapInArrow(run, _SENT)


_COUNTS = "lang string, words int, phrase string, f bigint"
_COUNT_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int64()]


def box_counts(lang: str, blobs: list[bytes], least: int, whole: bool):
    """Batches of (lang, words, phrase, f) of one box; words = 0 and a null phrase carry the number of all words."""
    names = ["lang", "words", "phrase", "f"]
    total = 0
    for kind in (1, 2):  # single words, then suffixes of several
        number, parts, weights = _Ids({b"": 0}), [], []
        for blob in blobs:
            words, rows, n = _open(blob)
            if (rows.shape[1] == 1) == (kind == 1):
                to = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                parts.append(to[rows]), weights.append(n)
        if not parts:
            continue
        keys, weight = np.concatenate(parts), np.concatenate(weights)
        del parts, weights
        words = list(number)
        if kind == 1:
            total = int(weight.sum())
        for depth, row, count in three_way(keys, weight, least if whole else 1):
            if kind == 2:  # leading words alone are counted above; of shorter phrases in boxes dealt again only a part is here
                keep = (depth > 1) & ((count >= least) | ((depth < keys.shape[1]) & (not whole)))
                depth, row, count = depth[keep], row[keep], count[keep]
            if len(row):
                text = [b" ".join([words[j] for j in keys[i, :d].tolist()]).decode() for i, d in zip(row.tolist(), depth.tolist())]
                yield _rows([[lang] * len(row), depth, text, count], names, _COUNT_KINDS)
    if total:
        yield _rows([[lang], [0], [None], [total]], names, _COUNT_KINDS)


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, words, phrase, f) of every word and phrase of up to ``most`` words with f >= ``least``; words = 0: all words.

    The number of boxes follows from the bytes of text. A box that one pair of words makes heavy is dealt
    out again by whole suffixes, and the parts of its shorter phrases are added up afterwards.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    boxes = max(1, math.ceil(size / BOX_BYTES))
    sent = durable(sent_suffixes(src, boxes, most), "suffixes")
    # At most one row per HEAVY suffixes.
    heavy = {r["box"]: math.ceil(r["n"] / HEAVY) for r in sent.groupBy("box").agg(F.sum("n").alias("n")).where(f"n > {2 * HEAVY}").collect()}
    dealt = _dealt_again(sent, heavy, boxes) if heavy else sent

    def run(batches):
        held: dict[tuple[str, int], list[bytes]] = {}  # still shrunk; opened box by box
        for batch in batches:
            for lang, box, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                held.setdefault((lang, box), []).append(blob)
        while held:
            (lang, box), blobs = held.popitem()
            yield from box_counts(lang, blobs, least, box < boxes)

    found = dealt.repartition(max(boxes, tasks(spark)), "lang", "box").mapInArrow(run, _COUNTS)
    counts = durable(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)), "counts")
    discard(sent)
    return counts


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, keep: int = KEEP, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score.

    Texts are lower-cased (A-Z) and split into pieces and words; null texts are empty, null languages
    ``und``. A phrase of 2 to ``most`` words is a candidate if it occurs ``least`` times (a). Each cut into
    two parts with counts l and r scores floor(1000000 a a / (l r)); the lowest counts, ties to the
    smaller first part. Candidates within a longer one with at least ``keep`` percent of their count go.
    Ties in score and count are in byte order of the phrase. Repeated rows count each; an empty table
    gives no rows.
    """
    counts = phrase_counts(docs, most, least, lang, text)
    phrases = counts.where("words > 0").select("lang", "phrase", "f")
    found = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    part = lambda i, k: F.concat_ws(" ", F.slice(F.split("phrase", " "), i, k))
    inner = found.where("words > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: part(i, k))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    cuts = found.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {keep} * a").select(
        "lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "decimal(38,0)"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000000 as {wide}) * cast(a as decimal(18,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
