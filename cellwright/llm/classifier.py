"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bytes_of, cut, documents, pieces


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` and ``sample_bytes`` bound the labelled rows that a fit uses: beyond them, rows are drawn by a hash of their id."""

    bits: int = 18
    sample_rows: int = 30_000
    sample_bytes: int = 256_000_000
    shards: int = 6
    passes: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.0001
    l2: float = 0.01


_UPPER, _LOWER = re.compile(rb"[A-Z]+"), re.compile(rb"(?:[a-z]|[\x80-\xff])+")
_SAME = crc32(b"same as the word before")


def shape(word: bytes) -> bytes:
    """The word with each run of capitals as A and of other letters as a: what unseen words share."""
    return _LOWER.sub(b"a", _UPPER.sub(b"A", word))


@dataclass
class WordHashes:
    """Hashes of words and of their shapes, kept for words seen before."""

    known: dict[bytes, tuple[int, int]] = field(default_factory=dict)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > 150_000:
            self.known = {}
        known, words = self.known, text.split()
        for w in set(words):
            if w not in known:
                known[w] = crc32(w), crc32(shape(w), 7)
        both = np.array([known[w] for w in words], np.uint64).reshape(-1, 2)
        spelled, shaped = both[:, 0], both[:, 1].copy()
        shaped[1:][spelled[1:] == spelled[:-1]] = _SAME
        return spelled, shaped


_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes, hashes: WordHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the hashed unigrams and bigrams of a text's words and of their shapes.

    In the shapes a word equal to the one before it is a mark of its own. The weights of each kind of n-gram have a unit sum of
    squares. A text without words has no features.
    """
    down = np.uint64(64 - bits)
    slots, values = [np.empty(0, np.int64)], [np.empty(0)]
    for h in hashes(text):
        for keys in (h * _MIX, (h[:-1] * _TURN + h[1:]) * _MIX):
            slot, count = np.unique((keys >> down).astype(np.int64), return_counts=True)
            value = np.log1p(count)
            slots.append(slot)
            values.append(value / np.sqrt((value**2).sum() or 1.0))
    return np.concatenate(slots), np.concatenate(values)


def _train(rows: list[tuple[bytes, int]], s: Settings) -> np.ndarray:
    """FTRL-proximal over the rows of one shard, both labels with the same total weight; the last slot is the bias."""
    hashes, n = WordHashes(), 1 << s.bits
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * s.l1 - zs) / ((s.beta + np.sqrt(g2[at])) / s.alpha + s.l2)
        return np.where(np.abs(zs) <= s.l1, 0.0, w)

    ones = sum(label for _, label in rows)
    share = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}
    data = []
    for text, label in rows:
        slot, value = features(text, hashes, s.bits)
        data.append((np.append(slot, n), np.append(value, 1.0).astype(np.float32), label))
    for _ in range(s.passes):
        for slot, value, label in data:
            w = weights(slot)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - label) * share[label] * value
            was = g2[slot]
            z[slot] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / s.alpha * w
            g2[slot] = was + g * g
    return weights(np.arange(n + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """Weights learned from ``labels`` (``doc_id``, ``label``); rows without id or label teach nothing.

    The labelled rows, at most about ``sample_rows`` with ``sample_bytes`` of text, are dealt to ``shards`` by a hash of their id. Each shard is
    trained alone and the weights are averaged, so what reaches the driver is one vector of ``2**bits + 1`` numbers a shard,
    whatever the corpus. Texts repeat when ids do. Without labelled rows all weights are 0.
    """
    s = settings
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).dropna()
    drawn = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30))
    sizes = documents(docs).select(F.col("doc_id").alias("label_id"), F.octet_length("text").alias("size")).join(known.select("label_id"), "label_id")
    n, size = known.count(), sizes.agg(F.sum("size")).first()[0] or 0
    part = min(1.0, s.sample_rows / max(n, 1), s.sample_bytes / max(size, 1))
    if part < 1:
        known = known.where(drawn < int((1 << 30) * part))
    # at most about sample_rows rows of two numbers
    rows = documents(docs).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    shard = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(s.shards))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        order = np.lexsort((part["text_key"].to_numpy(), part["turn"].to_numpy()))
        part = part.take(order)
        texts, marks = part["text"].cast(pa.binary()).to_pylist(), part["label"].to_pylist()
        w = _train(list(zip(texts, marks, strict=True)), s)
        return pa.table({"n": pa.array([len(texts)], pa.int64()), "w": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    picked = rows.select(shard.alias("shard"), F.xxhash64("label_id", F.lit(2)).alias("turn"), F.xxhash64("text").alias("text_key"), "text", "label")
    models = picked.groupBy("shard").applyInArrow(run, "n bigint, w binary").collect()
    total = np.zeros((1 << s.bits) + 1)
    for m in sorted(models, key=lambda m: bytes(m["w"])):
        total += np.frombuffer(m["w"], "<f4") * (m["n"] / sum(x["n"] for x in models))
    return total.astype("<f4")


def score(docs: DataFrame, weights: np.ndarray, bits: int = Settings.bits) -> DataFrame:
    """``(doc_id, text_key, score)``: the probability of label 1 as a sparse dot product. A text without words gets the bias alone.

    Every row of ``docs`` gives one row; nothing is shuffled. The weights, 4 * 2**bits bytes, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = np.frombuffer(shared.value, "<f4").astype(np.float64), WordHashes()
        for batch in pieces(batches):
            scores = []
            for text in bytes_of(batch):
                slot, value = features(text, hashes, bits)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(w[slot] @ value + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(scores, pa.float64())], ["doc_id", "text_key", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key bigint, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned: the check sum of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``(doc_id, text_key, held_out, score, predicted)`` of every row of ``docs``, by labels of rows not held out."""
    weights = fit(docs, labels.where(~held_out()), "quality", settings)
    return score(docs, weights, settings.bits).select(
        "doc_id", "text_key", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that are predicted to be good, with all their columns; rows equal in id and text share their fate."""
    bad = cut(quality_scores(docs, labels, settings).where("predicted = 0").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")), "bad")
    bad = bad.hint("merge")  # it grows with the documents: one plan at every size
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")
