"""Removal of byte strings that earlier documents hold too, over range-partitioned sorted suffixes.

Of each text only the suffixes at anchors are dealt out. Every string of LENGTH bytes has one
anchor: the place of its smallest hashed K-gram. Equal strings have it at the same place, so they
are found among the suffixes that begin with the same K bytes, read with the bytes before them.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from launchgrid.llm.common import discard, durable, mix, own_caches, ship, slices, tasks

LENGTH, K = 50, 16
BUFFER = 512 << 10          # bytes of text hashed at a time
FLUSH = 32 << 20            # bytes of text whose anchors are compared within a task first
GROUP_BYTES = 6 << 20       # text in a group of documents
BOX_BYTES = 12 << 20        # text whose suffixes go to one box, unless tasks are more
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 4000
SUFFIXES = 400_000          # sorted at a time
_BYTE = mix(np.arange(256, dtype=np.uint64), 21)
_POWER = 0x9E3779B97F4A7C15


def anchors(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, hash, place, first, last) per anchor of the texts that ``data`` joins.

    The strings that begin at first..last have their anchor at ``place``; all are offsets in ``data``.
    """
    a = np.frombuffer(data, np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if len(a) < LENGTH:
        return none
    h, power, step = _BYTE[a], _POWER, 1
    while step < K:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power % 2**64, step * 2
    h = mix(h)
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first place
    span, step = LENGTH - K + 1, 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: step - span], low[span - step:])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[doc])
    if not len(start):
        return none
    place = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(start)) - 1
    return doc[start[new]], h[place[new]], place[new], start[new], start[last]


def buffers(texts: list[bytes]):
    """(indices, offsets within their text, parts) of at most BUFFER bytes; longer texts in overlapping parts."""
    idx, at, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), BUFFER - LENGTH + 1):
            part = t[a: a + BUFFER]
            if size + len(part) > BUFFER and parts:
                yield idx, at, parts
                idx, at, parts, size = [], [], [], 0
            idx.append(i), at.append(a), parts.append(part)
            size += len(part)
    if parts:
        yield idx, at, parts


def group_of(key, mark, groups: int):
    """The group of a document, alike in columns and in arrays."""
    if isinstance(key, Column):
        return F.pmod(F.pmod(F.coalesce(key, F.lit(0)), F.lit(1_000_003)) * 7919 + mark, F.lit(groups))
    return (key % 1_000_003 * 7919 + mark) % groups


def _shrink(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 1)


def _grow(b: bytes):
    return pickle.loads(zstandard.decompress(b))


def _rows(rows: list[tuple[int, bytes]], names=("box", "blob")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], list(names))


def _by(box: np.ndarray, *cols: np.ndarray):
    """(box, columns) of the rows of each box, in order of the rows."""
    order = np.argsort(box, kind="stable")
    box = box[order]
    cut = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]])) if len(box) else []
    for a, b in zip(cut, [*cut[1:], len(box)]):
        yield int(box[a]), tuple(c[order[a:b]] for c in cols)


def shared_grams(src: DataFrame, groups: int, boxes: int) -> DataFrame:
    """(box, blob): per group of documents, the anchors' hashes that several documents have.

    A task first compares its own texts: a hash it meets in several documents goes back to these
    at once, and travels once, as known. So no hash travels more often than there are tasks,
    but for the versions of one key.
    """
    def send(batches):
        keys, marks, hashes, size = [], [], [], 0

        def flush():
            key, mark, h = (np.concatenate(x) for x in (keys, marks, hashes))
            order = np.lexsort((mark, key, h))
            key, mark, h = key[order], mark[order], h[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
            key, mark, h = key[once], mark[once], h[once]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            run = np.cumsum(first) - 1
            many = np.zeros(run[-1] + 1, bool)
            many[run[1:][(h[1:] == h[:-1]) & (key[1:] != key[:-1])]] = True
            out = []
            own = many[run]
            for box, (k, m, x) in _by(group_of(key[own], mark[own], groups), key[own], mark[own], h[own]):
                out.append((boxes + box, _shrink((k, m, x))))
            o = np.flatnonzero(first | ~own)  # all versions of a lone key, the first of several keys
            o = o[np.lexsort((mark[o], key[o]))]  # by document, so that its columns shrink to little
            for box, (k, m, x, y) in _by((h[o] >> np.uint64(32)).astype(np.int64) % boxes, key[o], mark[o], h[o], own[o]):
                out.append((box, _shrink((np.diff(k, prepend=0), m.astype(np.uint32), x, y))))
            return _rows(out)

        own_caches("suffixes", lambda: None)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, texts = batch.column(0).to_numpy(), [t.encode() for t in batch.column(1).to_pylist()]
            mark = np.array([zlib.crc32(t) for t in texts], np.int64)
            for idx, _, parts in buffers(texts):
                doc, h, *_ = anchors(b"".join(parts), np.array([len(p) for p in parts]))
                doc = np.array(idx)[doc]
                keys.append(ids[doc]), marks.append(mark[doc]), hashes.append(h)
                size += sum(map(len, parts))
                if size > FLUSH and sum(map(len, hashes)):
                    yield flush()
                    keys, marks, hashes, size = [], [], [], 0
        if sum(map(len, hashes)):
            yield flush()

    def meet(batches):
        keys, marks, hashes, known = [], [], [], []
        for batch in batches:
            for box, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if box >= boxes:
                    yield _rows([(box - boxes, blob)])
                    continue
                k, m, h, y = _grow(blob)
                keys.append(np.cumsum(k)), marks.append(m), hashes.append(h), known.append(y)
        if not keys:
            return
        key, mark, h, y = (np.concatenate(x) for x in (keys, marks, hashes, known))
        del keys, marks, hashes, known
        order = np.argsort(h, kind="stable")
        key, mark, h, y = key[order], mark[order].astype(np.int64), h[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | np.logical_or.reduceat(y, first)
        back = np.repeat(several, np.diff(np.append(first, len(h)))) & ~y
        key, mark, h = key[back], mark[back], h[back]
        out = [(box, _shrink(cols)) for box, cols in _by(group_of(key, mark, groups), key, mark, h)]
        for i in range(0, len(out), 64):
            yield _rows(out[i: i + 64])

    schema = "box bigint, blob binary"
    return src.select("doc_id", "text").where("doc_id is not null").mapInArrow(send, schema).repartition(boxes, "box").mapInArrow(meet, schema)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words, and the number of each ordered row's run of equal rows.

    Multikey sorting: by the first word, then within each run of equal words by the next, and
    only the runs that still have several rows go on.
    """
    order = np.argsort(words[:, 0], kind="stable")
    run = np.cumsum(np.concatenate([[0], words[order[1:], 0] != words[order[:-1], 0]])).astype(np.int64)
    for d in range(1, words.shape[1]):
        size = np.bincount(run)
        live = np.flatnonzero(size[run] > 1)
        if not len(live):
            break
        rows = order[live]
        again = np.lexsort((words[rows, d], run[live]))
        order[live] = rows[again]
        change = np.concatenate([[0], run[1:] != run[:-1]])
        w = words[order, d]
        tied = np.zeros(len(order), bool)
        tied[live] = True
        change |= np.concatenate([[False], tied[1:] & tied[:-1] & (w[1:] != w[:-1])])
        run = np.cumsum(change)
    return order, run


def covered(key: np.ndarray, data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) of the strings data[begin + shift:][:LENGTH], shift < count, that a smaller key has too.

    Many strings are dealt into passes by their own hash, so that few are held at a time.
    """
    row = np.repeat(np.arange(len(key)), count)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    view, wide = np.lib.stride_tricks.sliding_window_view(data, LENGTH), -(-LENGTH // 8) * 8

    def words(r, s):
        text = np.zeros((len(r), wide), np.uint8)
        text[:, :LENGTH] = view[begin[r] + s]
        return text.view(">u8").astype(np.uint64)

    def late(r, s):
        order, run = multikey_order(words(r, s))
        k = key[r[order]]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        hit = order[k > np.minimum.reduceat(k, first)[run]]
        return r[hit], s[hit]

    passes = -(-len(row) // (2 * SUFFIXES))
    if passes <= 1:
        return late(row, shift)
    of = np.concatenate([mix((words(row[i: i + SUFFIXES], shift[i: i + SUFFIXES]) * np.arange(1, wide // 4, 2, dtype=np.uint64)).sum(1)) % np.uint64(passes)
                         for i in range(0, len(row), SUFFIXES)])
    found = [late(row[of == p], shift[of == p]) for p in range(passes) if (of == p).any()]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def settle(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(key, mark, start, stop) of the spans of a box that smaller documents hold too.

    Of equal bytes around an anchor only those of the smallest document are sorted; the others are spans.
    """
    parts = [_grow(b) for b in blobs]
    blobs.clear()
    key, mark, start, inner, size = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(5))
    body = b"".join(p[5] for p in parts)
    del parts
    ends = np.cumsum(size)
    begin = ends - size
    same = np.empty((len(key), 2), np.uint64)
    for i, (a, e) in enumerate(zip(begin.tolist(), ends.tolist())):
        h = xxhash.xxh3_128_intdigest(body[a:e])
        same[i] = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    order = np.lexsort((key, same[:, 1], same[:, 0]))
    new = np.concatenate([[True], (same[order[1:]] != same[order[:-1]]).any(1)])
    least = np.empty(len(key), np.int64)
    least[order] = key[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = least < key
    spans = [(key[late], mark[late], start[late], start[late] + size[late])]
    data = np.frombuffer(body, np.uint8)
    rest = np.flatnonzero(~late)
    lead = [data[(begin + inner)[rest][:, None] + np.arange(8 * w, 8 * w + 8)].view(">u8").reshape(-1).astype(np.uint64) for w in range(K // 8)]
    order = np.lexsort(lead[::-1])
    rest = rest[order]
    change = np.flatnonzero(np.any([w[order][1:] != w[order][:-1] for w in lead], axis=0)) + 1
    edges = np.concatenate([[0], change, [len(rest)]])
    single = np.diff(edges) == 1
    alone = np.zeros(len(rest), bool)
    alone[edges[:-1][single]] = True
    weight = np.concatenate([[0], np.cumsum(np.where(alone, 0, size[rest] - LENGTH + 1))])
    i = 0
    while i < len(edges) - 1:  # runs of anchors with equal leading bytes, as many as fit
        j = max(i + 1, int(np.searchsorted(weight[edges], weight[edges[i]] + SUFFIXES, "right")) - 1)
        mine = rest[edges[i]: edges[j]][~alone[edges[i]: edges[j]]]
        if len(mine):
            row, shift = covered(key[mine], data, begin[mine], size[mine] - LENGTH + 1)
            at = start[mine][row] + shift
            spans.append(joined(key[mine][row], mark[mine][row], at, at + LENGTH))
        i = j
    return joined(*(np.concatenate(x) for x in zip(*spans)))


def marks_of(key, mark, start, stop, groups: int) -> list[tuple[int, bytes]]:
    """Spans start..stop of the documents, packed by group; touching spans of a document are joined."""
    order = np.lexsort((start, mark, key))
    key, mark, start, stop = key[order], mark[order], start[order], stop[order]
    return [(box, _shrink(cols)) for box, cols in _by(group_of(key, mark, groups), key, mark, start, stop)]


def splitters(src: DataFrame, n: int, boxes: int) -> np.ndarray:
    """First bytes of anchored suffixes that cut a bounded sample of documents into equal boxes."""
    every = max(1, n // SAMPLE_DOCS)
    part = src.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(every)) == 0).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_DOCS)
    words = []
    for idx, _, parts in buffers([r["text"].encode() for r in part.collect()]):
        data = b"".join(parts)
        words.append(first_bytes(data, anchors(data, np.array([len(p) for p in parts]))[2]))
    words = np.sort(np.concatenate(words)) if words else np.zeros(0, f"S{K}")
    return np.unique(words[np.linspace(0, len(words) - 1, boxes + 1).astype(int)[1:-1]]) if len(words) else words


def first_bytes(data: bytes, place: np.ndarray) -> np.ndarray:
    """The K bytes at each place, all that equal suffixes are known to share."""
    a = np.frombuffer(data + b"\0" * K, np.uint8)
    return a[place[:, None] + np.arange(K)].reshape(-1, K).view(f"S{K}").reshape(-1)


def find_repeats(src: DataFrame, shared: DataFrame, groups: int, boxes: int, cuts: np.ndarray) -> DataFrame:
    """(box, blob): per group of documents, the spans of bytes that smaller documents hold too.

    Each group reads its texts again and sends, for the anchors of shared hashes, the bytes around
    them to the box of their suffix. Equal bytes within a group are settled there; the rest is sorted
    in its box. Splitters never part suffixes that begin with the same K bytes, so every suffix meets
    all it can match.
    """
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_rows([])])
        box = left.column("box")[0].as_py()
        left = left.sort_by("doc_id")
        ids, texts = left.column("doc_id").to_numpy(), [t.encode() for t in left.column("text").to_pylist()]
        mark = np.array([zlib.crc32(t) for t in texts], np.int64)
        k, m, h = (np.concatenate(x) for x in zip(*map(_grow, right.column("blob").to_pylist())))
        wanted = np.unique(mix(k.astype(np.uint64) ^ mix(m.astype(np.uint64), 3), 4) ^ h)
        of_doc = mix(ids.astype(np.uint64) ^ mix(mark.astype(np.uint64), 3), 4)
        seen: dict[bytes, int] = {}
        done, sent = [], []
        for idx, at, parts in buffers(texts):
            data = b"".join(parts)
            sizes = np.array([len(p) for p in parts])
            doc, h, place, first, last = anchors(data, sizes)
            whole = np.array(idx)[doc]
            good = np.flatnonzero(np.isin(of_doc[whole] ^ h, wanted))
            off = (np.cumsum(sizes) - sizes)[doc] - np.array(at)[doc]  # from the buffer to the text
            word = first_bytes(data, place[good])
            for i, d, w, f, e, p, o in zip(good.tolist(), whole[good].tolist(), word, first[good].tolist(), last[good].tolist(), place[good].tolist(), off[good].tolist()):
                body = data[f: e + LENGTH]
                key = int(ids[d])
                if seen.setdefault(body, key) < key:
                    done.append((key, mark[d], f - o, e + LENGTH - o))
                else:
                    sent.append((w, key, mark[d], f - o, p - f, body))
        out = []
        if done:
            out += [(boxes + b, x) for b, x in marks_of(*(np.array(c, np.int64) for c in zip(*done)), groups)]
        if sent:
            sent.sort(key=lambda r: r[0])
            word, key, mk, start, inner = (np.array(c, t) for c, t in zip(list(zip(*sent))[:5], (f"S{K}", *[np.int64] * 4)))
            to = np.searchsorted(cuts, word, "right")
            for b, (rows,) in _by(to, np.arange(len(sent))):
                body = [sent[i][5] for i in rows.tolist()]
                out.append((b, _shrink((key[rows], mk[rows].astype(np.uint32), start[rows], inner[rows].astype(np.uint16), np.array([len(x) for x in body], np.uint16), b"".join(body)))))
        return pa.Table.from_batches([_rows(out)])

    def meet(batches):
        held: dict[int, list[bytes]] = {}  # still shrunk; grown box by box
        for batch in batches:
            for box, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if box >= boxes:
                    yield _rows([(box - boxes, blob)])
                else:
                    held.setdefault(box, []).append(blob)
        while held:
            out = marks_of(*settle(held.popitem()[1]), groups)
            for i in range(0, len(out), 64):
                yield _rows(out[i: i + 64])

    schema = "box bigint, blob binary"
    dealt = src.where("doc_id is not null").select("box", "doc_id", "text").groupBy("box").cogroup(shared.groupBy("box")).applyInArrow(send, schema)
    return dealt.repartition(boxes, "box").mapInArrow(meet, schema)


def joined(key, mark, start, stop) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of a document as one."""
    order = np.lexsort((start, mark, key))
    key, mark, start, stop = key[order], mark[order], start[order], stop[order]
    if not len(key):
        return key, mark, start, stop
    doc = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])).astype(np.int64)
    top = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc * top) - doc * top  # furthest end so far within the document
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]))
    return key[new], mark[new], start[new], reach[np.append(new[1:], len(key)) - 1]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Remove every byte within a 50-byte string that also begins in a document with a smaller key.

    Strings are judged on the input and never cross documents; repeats within one document stay.
    With ``digests``: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Otherwise the documents with
    all their columns, their text replaced by what is kept (bytes of a cut character go too).
    Null texts are empty (null stays null in the documents); rows with a null key neither remove nor
    lose anything; rows that repeat a key do not remove from each other. Keys are whole numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    groups, boxes = (max(least, math.ceil((total["b"] or 0) / size)) for least, size in ((1, GROUP_BYTES), (tasks(spark), BOX_BYTES)))
    box = group_of(F.col("doc_id"), F.crc32(F.col("text").cast("binary")), groups)
    shared = durable(shared_grams(src, groups, boxes), "grams")
    cuts = splitters(src, total["n"], boxes)
    spans = durable(find_repeats(src.withColumn("box", box), shared, groups, boxes, cuts), "spans")
    names = docs.columns
    at = names.index(text)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        if right.num_rows:
            k, m, a, b = (np.concatenate(x) for x in zip(*map(_grow, right.column("blob").to_pylist())))
            k, m, a, b = joined(k, m, a, b)
            for _, (k1, m1, a1, b1) in _by(np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])), k, m, a, b):
                found[int(k1[0]), int(m1[0])] = [a1, b1]
        rows = []
        ids, raw = left.column("_key").to_pylist(), left.column("_text" if digests else f"_{at}").to_pylist()
        for k, t in zip(ids, raw):
            data = (t or "").encode()
            a, b = found.get((k, zlib.crc32(data)), ((), ())) if found else ((), ())
            kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)]))
            rows.append((len(data), len(data) - len(kept), len(a), kept, t))
        if digests:
            cols = [left.column("_key")] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            return pa.table(cols + [pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        new = pa.array([None if r[4] is None else r[3].decode("utf-8", "ignore") for r in rows], pa.string())
        return pa.table([new if i == at else left.column(f"_{i}") for i in range(len(names))], [f"_{i}" for i in range(len(names))])

    whole = docs.toDF(*[f"_{i}" for i in range(len(names))])  # plain names: theirs cannot clash with ours
    whole = whole.withColumn("_key", F.col(f"_{names.index(key)}").cast("bigint")).withColumn("_text", F.coalesce(f"_{at}", F.lit("")))
    whole = whole.withColumn("_box", group_of(F.col("_key"), F.crc32(F.col("_text").cast("binary")), groups))
    whole = whole.select("_box", "_key", "_text") if digests else whole.drop("_text")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if digests else ", ".join(
        f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = whole.groupBy("_box").cogroup(spans.groupBy("box")).applyInArrow(finish, schema)
    return out if digests else out.toDF(*names)
