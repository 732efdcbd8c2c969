"""Near-duplicate documents: band candidates, b-bit signatures, exact confirmation on full sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import components, discard, durable, mix, own_caches, pick, ship, slices

SHINGLE = 5
BANDS, ROWS = 20, 5      # a pair of similarity 0.8 shares no band with probability 0.0004
MINIMA = 128             # the first BANDS * ROWS make the bands, all make the signature
BITS = 4                 # kept of each minimum
MARGIN = 0.13            # four deviations of the estimate at 0.85
BLOCK = 2048
CACHE_WORDS = 500_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    own_caches("shingles", _words.cache_clear)
    return _Words()


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1), rng.integers(0, 2**64, MINIMA, np.uint64)


_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of the whole text if it has fewer words."""
    words = text.encode().lower().split()
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix((h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i, c in enumerate(_PLACE):
        total += mix(h[i: i + n]) * c
    return np.unique(mix(total))


def minima(items: np.ndarray) -> np.ndarray:
    a, b = _factors()
    out = np.full(MINIMA, 2**32 - 1, np.uint64)
    for i in range(0, len(items), 2048):
        np.minimum(out, ((items[i: i + 2048, None] * a + b) >> np.uint64(32)).min(0), out=out)
    return out


def signature(low: np.ndarray) -> bytes:
    """The low bits of all minima, 16 to a 64-bit word."""
    part = (low & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(part << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).astype("<u8").tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of words), corrected for low bits that agree by chance."""
    x = a ^ b
    for i in range(1, BITS):
        x |= (a ^ b) >> np.uint64(i)
    every = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    same = MINIMA - np.bitwise_count(x & every).sum(axis=1)
    chance = 2.0**-BITS
    return (same / MINIMA - chance) / (1 - chance)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (of the set), sig, bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, h1, h2, sig, bands = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t)
                    n.append(len(s))
                    h1.append(int(mix(s, 1).sum().astype(np.int64)) if len(s) else None)
                    h2.append(int(mix(s, 2).sum().astype(np.int64)) if len(s) else None)
                    low = minima(s) if len(s) else None
                    sig.append(signature(low) if len(s) else None)
                    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS) if len(s) else None
                    bands.append(mix((mix(rows + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(1 << 40)) * _PLACE).sum(1)).astype(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "sig", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, sig binary, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): the full set, as bytes, of the wanted (node, low, h1), read from the document ``low``."""
    joined = docs.join(wanted.withColumnRenamed("low", "doc_id"), "doc_id").select("node", "text", "h1")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keep, out = [], []
                for i, (t, h) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    s = shingles(t)
                    if len(s) and int(mix(s, 1).sum().astype(np.int64)) == h:
                        keep.append(i), out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["node", "items"])

    return joined.mapInArrow(run, "node bigint, items binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def blocks(batches, handle, rows: int = 4 * BLOCK):
    """Feed ``handle`` with whole blocks of rows in the order of (band, s, q), many small blocks at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        tab = pa.Table.from_batches(held).combine_chunks()
        key = [tab.column(c).to_numpy() for c in ("band", "s", "q")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield from handle(tab.slice(0, cut)).to_batches()
        held, size = tab.slice(cut).to_batches(), tab.num_rows - cut
    if size:
        yield from handle(pa.Table.from_batches(held).combine_chunks()).to_batches()


def plausible(tab: pa.Table, least: float, percent: int):
    """(asking row, stored row, estimate) of the pairs of a block that may link and are not connected yet.

    A pair that shares several bands is met in the first of them only.
    """
    n, comp = tab.column("n").to_numpy(), tab.column("comp").to_numpy()
    sig = np.frombuffer(b"".join(tab.column("sig").to_pylist()), np.uint64).reshape(len(n), -1)
    bands = tab.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    asks = tab.column("asks").to_numpy()
    keys = [tab.column(c).to_numpy() for c in ("band", "s", "q")]
    block = np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0).cumsum()])
    stored, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    lo, hi = np.searchsorted(block[stored], block[asking], "left"), np.searchsorted(block[stored], block[asking], "right")
    at = np.concatenate([[0], np.cumsum(hi - lo)])
    i = 0
    while i < len(asking):
        j = max(i + 1, int(np.searchsorted(at, at[i] + 200_000, "right")) - 1)
        size = (hi - lo)[i:j]
        a = np.repeat(asking[i:j], size)
        b = stored[np.repeat(lo[i:j], size) + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)]
        ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        e = estimate(sig[a], sig[b])
        ok = np.flatnonzero(e >= least)
        a, b, e = a[ok], b[ok], e[ok]
        ok = bands[a, (bands[a] == bands[b]).argmax(1)] == keys[0][a]
        yield a[ok], b[ok], e[ok]
        i = j


def participants(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """The rows that have a plausible partner in their block, found from signatures alone."""
    def handle(tab: pa.Table) -> pa.Table:
        some = np.zeros(tab.num_rows, bool)
        for a, b, _ in plausible(tab, least, percent):
            some[a] = some[b] = True
        return tab.filter(pa.array(some))

    ordered = rows.repartition("band", "s", "q").sortWithinPartitions("band", "s", "q", "asks", "node")
    return ordered.mapInArrow(lambda batches: blocks(batches, handle), rows.schema)


def block_links(rows: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) that join all components whose documents link within a block.

    Each asking document goes through its plausible partners by estimate and compares full sets
    with those not connected to it so far. Pairs never leave the block, only new links do.
    """
    kind = rows.schema["node"].dataType.simpleString()

    def handle(tab: pa.Table) -> pa.Table:
        comp, items = tab.column("comp").to_numpy(), tab.column("items")
        up: dict = {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        got: dict[int, np.ndarray] = {}
        out_a, out_b = [], []
        for a, b, e in plausible(tab, least, percent):
            for i in np.lexsort((-e, a)).tolist():
                x, y = int(a[i]), int(b[i])
                rx, ry = root(comp[x]), root(comp[y])
                if rx == ry:
                    continue
                for k in (x, y):
                    if k not in got:
                        got[k] = np.frombuffer(items[k].as_py(), np.uint64)
                inter = len(np.intersect1d(got[x], got[y], assume_unique=True))
                if 100 * inter >= percent * (len(got[x]) + len(got[y]) - inter):
                    up[max(rx, ry)] = min(rx, ry)
                    out_a.append(x), out_b.append(y)
        names = tab.column("node").combine_chunks()
        take = lambda x: names.take(pa.array(x, pa.int64()))
        return pa.table([take(out_a), take(out_b)], ["a", "b"])

    full = rows.join(sets, "node")
    ordered = full.repartition("band", "s", "q").sortWithinPartitions("band", "s", "q", "asks", "node")
    return ordered.mapInArrow(lambda batches: blocks(batches, handle, BLOCK), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= percent * union of their sets of five-word shingles.
    Equal sets become one node, numbered in a written table. Nodes that share a band are candidates: first each asks the one
    leader of its bands that it looks most like; then those apart from a band's leader ask the
    other nodes of the band, best estimates first, until all candidates are confirmed, refuted or
    already connected. Nothing is skipped for the size of a band: its rows meet in blocks of
    bounded size, and pairs do not leave them.
    Texts without words are empty and link with nothing, as do null keys, whose component is null.
    Rows that repeat a key are versions of one document and share its links.
    """
    spark = docs.sparkSession
    ship(spark)
    src = pick(docs, key, text)
    sk = durable(sketches(src), "sketches")
    some = sk.where("n_shingles > 0 and doc_id is not null")
    groups = durable(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "groups")
    rows = groups.select("node", "low", "n", "sig", "h1", "bands", F.explode("bands").alias("band"))
    order = F.xxhash64("node", F.lit(9))
    leaders = durable(rows.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct(order.alias("o"), "node", "n", "sig")).alias("l")).where("m > 1").select(
        "band", F.col("l.node").alias("l_node"), F.col("l.n").alias("l_n"), F.col("l.sig").alias("l_sig")), "leaders")
    rows = durable(rows.join(leaders.select("band", "l_node", "l_n", "l_sig"), "band"), "rows")  # of bands with several nodes
    least = percent / 100 - MARGIN
    words = MINIMA * BITS // 64
    word = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("bigint")
    every = int("1" * 16, 16)

    def unlike(i):
        x = word("sig", i).bitwiseXOR(word("l_sig", i))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(y.bitwiseAND(F.lit(every)))

    differ = sum((unlike(i) for i in range(1, words)), unlike(0))
    most = int(MINIMA * (1 - (least * (1 - 2.0**-BITS) + 2.0**-BITS)))
    asked = rows.where("node <> l_node").where(100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")).withColumn("differ", differ).where(F.col("differ") <= most)
    pairs = durable(asked.groupBy("node").agg(F.min(F.struct("differ", "l_node")).alias("x")).select(F.least("node", "x.l_node").alias("a"), F.greatest("node", "x.l_node").alias("b")).distinct(), "pairs")
    sets = durable(full_sets(src, rows.select("node", "low", "h1").distinct()), "sets")
    links = durable(confirmed(pairs, sets, percent), "links")
    comp = durable(components(links), "components")
    placed = durable(rows.select("band", "bands", "node", "n", "sig", "l_node").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), "placed")
    apart = placed.groupBy("band").agg(F.max(F.when(F.col("node") == F.col("l_node"), F.col("comp"))).alias("lead"), F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    apart = durable(apart.select("band", "lead", F.ceil(F.col("m") / BLOCK).cast("int").alias("s_n")), "apart")
    mixed = placed.join(apart, "band")
    salt = F.pmod(F.xxhash64("node"), F.col("s_n"))
    all_salts = F.sequence(F.lit(0), F.col("s_n") - 1).cast("array<bigint>")
    stored = mixed.select("band", "bands", "node", "n", "sig", "comp", F.lit(False).alias("asks"), salt.alias("s"), F.explode(all_salts).alias("q"))
    asking = mixed.where("comp <> lead").select("band", "bands", "node", "n", "sig", "comp", F.lit(True).alias("asks"), F.explode(all_salts).alias("s"), salt.alias("q"))
    near = durable(participants(stored.unionByName(asking), least, percent), "participants")
    discard(placed)
    found = durable(block_links(near, sets, least, percent), "links")
    named = durable(sk.select("doc_id", "n_shingles", "h1", "h2").join(groups.select("h1", "h2", "node", "low"), ["h1", "h2"], "left"), "named")
    # Rows that repeat a key with other texts are versions of one document.
    versions = named.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    versions = durable(named.join(versions.drop("z"), "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "versions")
    comp = durable(components(links.unionByName(found).unionByName(versions)), "components")
    member = groups.select("node", "low").join(comp, "node")
    first = durable(member.join(member.groupBy("component").agg(F.min("low").alias("first")), "component").select("node", "first"), "firsts")
    out = named.join(first, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "low", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest key of their group, with all their columns.

    Documents without words or key stay. Of rows that repeat a kept key, equal texts stay once.
    An empty table stays empty; columns of any name are carried along.
    """
    found = durable(near_duplicates(docs, percent, key, text), "found")
    flags = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("gone"), F.count("*").alias("m")).where("gone or m > 1")
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])  # their names cannot clash with ours
    at, body = f"_{names.index(key)}", f"_{names.index(text)}"
    flags = durable(flags, "flags")
    kept = plain.join(flags, F.col(at) == F.col("doc_id"), "left").where("gone is null or not gone")
    if flags.where("m > 1 and not gone").isEmpty():
        return kept.select(*plain.columns).toDF(*names)
    once = kept.where("m is null").select(*plain.columns)
    return once.unionByName(kept.where("m is not null").dropDuplicates([at, body]).select(*plain.columns)).toDF(*names)
