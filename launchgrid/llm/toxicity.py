"""Toxicity scores by non-negative positive-unlabelled learning over hashed words."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import discard, durable, mix, pick, ship, slices

SAMPLE_POSITIVE = 4000  # bound of the confirmed examples that are learned from
SAMPLE_REST = 12000     # bound of the unlabelled texts that are learned from
THRESHOLD = 0.3
STRIP = ".,;:!?\"'()[]{}<>*#&$%|-_"  # fixed values: marks that do not belong to a word
CACHE_WORDS = 900_000
SKETCH, AGREE = 32, 24  # minima in the sketch that tells near copies, and how many of them these share
CLEAR = 5.0             # standard errors between the shares of a word that gets a weight


def bucket(word: str) -> int:
    return zlib.crc32(word.strip(STRIP).lower().encode())


@dataclass
class Model:
    weights: dict[int, float]  # of hashed words; at most as many as clear words in the bounded sample
    bias: float

    def scorer(self):
        known: dict[str, float] = {}

        def score(text: str) -> float:
            """Strength of the distinct words that speak for the class, less that of the others."""
            words = set(text.split())
            new = [w for w in words if w not in known]
            if new:
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = list(words)
                known.update((w, self.weights.get(bucket(w), 0.0)) for w in new)
            total = sum(sorted(map(known.__getitem__, words)))
            return float(1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500))))

        return score


@dataclass
class Example:
    words: np.ndarray   # buckets of the distinct words
    sketch: np.ndarray  # minima of hashed word pairs; as large a part of them is shared as of the pairs


def example(text: str) -> Example:
    words = text.split()
    pairs = np.unique(np.fromiter((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or words)), np.uint64))
    marks = np.array([mix(pairs, seed).min() for seed in range(SKETCH)] if len(pairs) else [0] * SKETCH, np.uint64)
    return Example(np.unique(np.fromiter((bucket(w) for w in set(words)), np.int64)), marks)


def distinct(examples: list[Example]) -> list[Example]:
    """The first of each group of near copies, so that their words do not count many times.

    An example goes only if it shares AGREE minima with one and the same example that stays.
    """
    kept = np.zeros((SKETCH, len(examples)), np.uint64)
    out: list[Example] = []
    for e in examples:
        n = len(out)
        if not n or (kept[:, :n] == e.sketch[:, None]).sum(0, dtype=np.uint8).max() < AGREE:
            kept[:, n] = e.sketch
            out.append(e)
    return out


def fit(positive: list[Example], unlabelled: list[Example], prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Logistic weights that minimise the non-negative positive-unlabelled risk.

    The risk of the rejected class is estimated from the unlabelled texts less ``prior`` times the
    positive ones; where that estimate turns negative its gradient is reversed, so that the model
    does not learn unlabelled positives by heart. Only words whose share among the positives
    differs clearly from that among the unlabelled get a weight. No positives or no prior: every
    score is near 0.
    """
    positive, unlabelled = distinct(positive), distinct(unlabelled)
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -6.0)
    prior = min(prior, 0.9)
    both = positive + unlabelled
    n, k = len(both), len(positive)
    rows = np.repeat(np.arange(n), [len(e.words) for e in both])
    names, cols = np.unique(np.concatenate([e.words for e in both]), return_inverse=True)
    mine = np.bincount(cols[rows < k], minlength=len(names))
    seen = np.bincount(cols, minlength=len(names))
    share = seen / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / k + 1 / (n - k)))
    clear = (np.abs(mine / k - (seen - mine) / (n - k)) >= CLEAR * spread) & (seen >= 3)
    keep = clear[cols]
    used, cols = np.unique(cols[keep], return_inverse=True)
    rows = rows[keep]
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    wp, wu = prior / k, 1.0 / (n - k)
    for step in range(1, epochs + 1):
        z = np.bincount(rows, w[cols], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z)  # of calling a text negative
        rest = wu * loss[k:].sum() - wp * loss[:k].sum()
        grad = np.empty(n)
        if rest >= 0:
            grad[:k] = wp * (p[:k] - 1) - wp * p[:k]
            grad[k:] = wu * p[k:]
        else:
            grad[:k], grad[k:] = wp * p[:k], -wu * p[k:]
        g = np.append(np.bincount(cols, grad[rows], len(used)) + decay * w, grad.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(dict(zip(names[used].tolist(), w.tolist())), float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out quarter.

    A label counts where it is 0 or 1; a document with several labels is positive if one of them
    is. The prior is the share of positives among all labelled rows. Positives and unlabelled texts
    (labelled documents with their label hidden) are those with the smallest hash of the key, at most
    SAMPLE_POSITIVE and SAMPLE_REST, so the driver's memory stays bounded. Their texts are read whole.
    """
    y = labels.where(F.col(label).isin(0, 1)).where(~held_out(key)).groupBy(F.col(key).alias("doc_id")).agg(F.max(label).alias("y"))
    y = y.where("doc_id is not null")
    total, ones = y.agg(F.count("*"), F.sum("y")).first()
    picked = y.where("y = 1").orderBy(F.xxhash64("doc_id")).limit(SAMPLE_POSITIVE).unionByName(
        y.withColumn("y", F.lit(-1)).orderBy(F.xxhash64("doc_id", F.lit(1))).limit(SAMPLE_REST))
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    texts = F.broadcast(picked).join(whole, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    ship(docs.sparkSession)

    def learn(batches):
        for batch in batches:
            for part in slices(batch):
                got = [example(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([e.words.astype(np.uint32).tobytes() for e in got], pa.binary()), pa.array([e.sketch.tobytes() for e in got], pa.binary())],
                    ["rank", "y", "words", "sketch"])

    # The texts stay in the tasks; only their words and sketches reach the driver.
    made = durable(texts.select(F.xxhash64("doc_id").alias("rank"), "y", "text").mapInArrow(learn, "rank bigint, y int, words binary, sketch binary"), "examples")
    found: dict[int, list[tuple]] = {1: [], -1: []}
    for r in made.toLocalIterator():
        found[r["y"]].append((r["rank"], bytes(r["words"]), bytes(r["sketch"])))
    discard(made)
    learned = {y: [Example(np.frombuffer(w, np.uint32).astype(np.int64), np.frombuffer(m, np.uint64)) for _, w, m in sorted(rows)] for y, rows in found.items()}
    return fit(learned[1], learned[-1], (ones or 0) / max(total, 1))


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1), predicted. Only the whole text is read.

    Null and empty texts get the score of the bias alone; held_out of a null key is null.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    src = pick(docs, key, text)
    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([of(t or "") < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
