"""Ranked lexical search: short posting lists are summed first, then one walk over documents skips through the long ones."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bytes_of, cut, documents, pieces

TOP = 10
#: Text of items searched in one pass over the documents; more items make more passes.
BLOCK_BYTES = 4_000_000
#: Documents of one step of the walk, and the share of a shard's documents that the short lists of an item may hold.
STEP, SHORT_SHARE = 512, 0.125
LAST = (1 << 63) - 1

# letters and digits of ASCII, lower-cased, and every byte of other characters; the rest separates terms
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: maximal runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.translate(_TERMS).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc, n, terms, tfs)``: a document's length and its terms of the ``vocabulary``, by number, with their counts."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = number.get, len(number) + 1
        for batch in pieces(batches):
            lengths, keys = [], [np.empty(0, np.int64)]
            for row, text in enumerate(bytes_of(batch)):
                words = terms_of(text)
                lengths.append(len(words))
                ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                keys.append(ids[ids >= 0] + row * size)
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            at = np.searchsorted(found, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array((found % size).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(counts.astype(np.int64))),
                ],
                ["doc", "n", "terms", "tfs"],
            )

    held = documents(docs).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), "text")
    return held.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tfs array<bigint>")


def length_norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * n * n_docs) div total, in Python's integers where 64 bits might not hold the product."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // total
    return np.array([10 + 90 * x * n_docs // total for x in n.tolist()], np.int64)


@dataclass
class PostingList:
    """The documents of a term in a shard, ascending, with what the term adds to each, and the largest addend by step."""

    docs: np.ndarray
    scores: np.ndarray
    cuts: np.ndarray = field(init=False)
    bounds: np.ndarray = field(init=False)

    def by_steps(self, steps: int) -> PostingList:
        self.cuts = np.searchsorted(self.docs, np.arange(steps + 1) * STEP)
        self.bounds = np.zeros(steps, np.int64)
        full = np.flatnonzero(self.cuts[1:] > self.cuts[:-1])
        if len(full):
            self.bounds[full] = np.maximum.reduceat(self.scores, self.cuts[full])
        return self


def shard_lists(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, total: int) -> tuple[np.ndarray, dict[int, PostingList]]:
    """Ids of a shard's documents in ascending order, and its posting lists."""
    ids = batch.column("doc").to_numpy()
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    norms = length_norms(batch.column("n").to_numpy(), n_docs, total)
    lists = batch.column("terms")
    row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    terms = lists.flatten().to_numpy().astype(np.int64)
    tf = batch.column("tfs").flatten().to_numpy()
    addends = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * norms[row]))
    by_term = np.lexsort((place[row], terms))
    terms, at, addends = terms[by_term], place[row][by_term], addends[by_term]
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, np.int64)
    steps = -(-len(ids) // STEP)
    ends = [*first[1:].tolist(), len(terms)]
    return ids[order], {int(terms[a]): PostingList(at[a:b], addends[a:b]).by_steps(steps) for a, b in zip(first.tolist(), ends, strict=False)}


def accumulated(short: list[PostingList], steps: int) -> PostingList:
    """The short lists summed term by term: one list of their documents, whose bounds are the largest sums."""
    docs, inverse = np.unique(np.concatenate([x.docs for x in short]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, inverse, np.concatenate([x.scores for x in short]))
    return PostingList(docs, sums).by_steps(steps)


def search_shard(ids: np.ndarray, lists: list[PostingList], best: list[tuple[int, int]], top: int) -> None:
    """Bring ``best``, a heap of ``(score, -doc)``, up to date with a shard's documents.

    Lists are taken from the shortest on into the accumulators while they hold at most ``SHORT_SHARE`` of the shard. The accumulators
    then are one iterator beside the long lists. The walk goes through steps of documents, skips those whose bounds add up to
    less than the lowest score of a full heap, and in a step adds lists from the highest bound on, until what is left can
    lift no document to that score. Equal scores are never skipped: the smaller id wins, which only the heap can tell.
    """
    if not lists:
        return
    steps, room = -(-len(ids) // STEP), max(STEP, int(len(ids) * SHORT_SHARE))
    lists = sorted(lists, key=lambda x: len(x.docs))
    short = 0
    while short < len(lists) and (room := room - len(lists[short].docs)) >= 0:
        short += 1
    cursors = ([accumulated(lists[:short], steps)] if short else []) + lists[short:]
    bounds = np.stack([x.bounds for x in cursors])
    totals = bounds.sum(axis=0)
    for step in range(steps):
        floor = best[0][0] if len(best) == top else 1
        if totals[step] < floor:
            continue
        base = step * STEP
        scores = np.zeros(min(STEP, len(ids) - base), np.int64)
        left = int(totals[step])
        for c in np.argsort(-bounds[:, step], kind="stable").tolist():
            if int(scores.max()) + left < floor:
                break
            x = cursors[c]
            a, b = x.cuts[step], x.cuts[step + 1]
            scores[x.docs[a:b] - base] += x.scores[a:b]
            left -= int(bounds[c, step])
        else:
            good = np.flatnonzero(scores >= floor)
            if len(good) > top:
                # ids ascend with the place, so a stable sort keeps the smallest of equal scores
                good = good[np.argsort(-scores[good], kind="stable")[:top]]
            for at in good.tolist():
                entry = (int(scores[at]), -int(ids[base + at]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _best(postings: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """``(item, doc, score)``: the ``top`` documents of every item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in pieces(batches, 16_000_000):
            ids, lists = shard_lists(batch, weights, n_docs, total)
            for item, terms in enumerate(items):
                search_shard(ids, [lists[t] for t in terms if t in lists], best[item], top)
        rows = [(item, -doc, score) for item, heap in enumerate(best) for score, doc in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["item", "doc", "score"])

    return postings.mapInArrow(run, "item int, doc bigint, score bigint")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item of ``benchmark`` its ``top`` documents by integer BM25.

    Hybrid of term and document order. The documents are dealt over tasks, each with posting lists of the items' terms.
    For an item, a task first sums its short lists term by term into accumulators, then walks through its documents with
    the accumulators as one bounded iterator beside the long lists, and skips what can't reach the item's lowest kept score.
    The tasks' lists of ``top`` documents are merged by rank. Weights come from counts over all documents.

    Items go through in blocks of about ``block_bytes`` of text, each a pass over all documents, so no number of items has to fit
    into a task. Rows equal in item_id and text are one item; items that share only the id are ranked each for themselves.
    Null texts have no terms: such items find nothing, such documents are never found. A null doc_id stands after all others among
    equal scores; repeated documents each count and take ranks of their own. Very long texts are read whole. Empty tables
    give no rows; other columns are never read.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total_bytes = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = -(-total_bytes // block_bytes)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks))))
    parts = []
    for block in range(n_blocks):
        held = items.where(F.col("block") == block).select("item_id", "text").collect()
        term_sets = [sorted(set(terms_of(r.text.encode()))) for r in held]
        vocabulary = sorted(set().union(*term_sets))
        number = {t: i for i, t in enumerate(vocabulary)}
        postings = cut(_postings(docs, vocabulary), "postings")
        n_docs, total = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not held or not n_docs:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r["term"]] = term_weight(n_docs, r["count"])
        found = _best(postings, [[number[t] for t in ts] for ts in term_sets], weights, n_docs, total, top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(held)], f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        # a row an item of the block
        parts.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", _id("doc").alias("doc_id"), "score"))
    if not parts:
        return benchmark.where("false").selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _id(doc: str) -> Column:
    return F.when(F.col(doc) != LAST, F.col(doc))
