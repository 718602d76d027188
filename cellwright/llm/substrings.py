"""Repeated word windows: super-windows that share a minimiser meet in its bucket, where sorting counts their windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bytes_of, cut, pieces, with_key
from .minimisers import super_windows

WINDOW, GRAM = 50, 8
#: Buckets with up to this many strings are sorted in one task, larger ones are split by the words that their windows share.
BUCKET = 500
#: Parts of the places of a minimiser in a window, by which a bucket is split first; each is halved from then on.
INTERVALS = 8
LAST = (1 << 63) - 1


def word_symbols(words: list[bytes]) -> np.ndarray:
    import xxhash

    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.array([known[w] for w in words], np.uint64)


def _super_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each super-window with its key, a digest of its words, its first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches):
            at, keys, digests, firsts, counts = [], [], [], [], []
            for i, text in enumerate(bytes_of(batch)):
                words = text.split()
                if len(words) < window:
                    continue
                symbols = word_symbols(words)
                key, _, first, last = super_windows(symbols, window, gram)
                raw = symbols.tobytes()
                at.append(np.full(len(key), i))
                keys.append(key.view(np.int64))
                spans = zip((first * 8).tolist(), ((last + window) * 8).tolist(), strict=True)
                digests.append(np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans], np.uint64).view(np.int64))
                firsts.append(first)
                counts.append(last - first + 1)
            if at:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(rows),
                        batch.column("text_key").take(rows),
                        *[pa.array(np.concatenate(x), t) for x, t in ((keys, pa.int64()), (digests, pa.int64()), (firsts, pa.int32()), (counts, pa.int32()))],
                    ],
                    ["doc", "text_key", "key", "digest", "first", "n"],
                )

    return ordered(docs).mapInArrow(run, "doc bigint, text_key bigint, key bigint, digest bigint, first int, n int")


def ordered(docs: DataFrame) -> DataFrame:
    """``(doc, text_key, text)`` with a null id after all others."""
    return with_key(docs).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), "text_key", "text")


def _packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the ``wanted`` super-windows ``(key, digest, doc, text_key, first, n)``, each as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: dict[str, list] = {c: [] for c in ("key", "digest", "doc", "text_key", "first", "packed")}
            spans = batch.column("spans").to_pylist()
            for doc, text_key, text, parts in zip(
                batch.column("doc").to_pylist(), batch.column("text_key").to_pylist(), bytes_of(batch), spans, strict=True
            ):
                words = text.split()
                for p in parts:
                    for c, v in zip(out, (p["key"], p["digest"], doc, text_key, p["first"], b" ".join(words[p["first"] : p["first"] + p["n"] + window - 1])), strict=True):
                        out[c].append(v)
            if out["key"]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    spans = wanted.groupBy("doc", "text_key").agg(F.collect_list(F.struct("key", "digest", "first", "n")).alias("spans"))
    # both sides grow with the corpus; one plan at every size
    held = ordered(docs).join(spans.hint("merge"), ["doc", "text_key"])
    return held.mapInArrow(run, "key bigint, digest bigint, doc bigint, text_key bigint, first int, packed binary")


_FOUND = "key bigint, digest bigint, doc bigint, text_key bigint, start int, stop int"
_STRING = "bucket bigint, key bigint, digest bigint, doc bigint, text_key bigint, first int, packed binary"


def _in_buckets(strings: DataFrame, window: int) -> DataFrame:
    """``(key, digest, doc, text_key, start, stop)``: words covered by windows that start in an earlier document of the same bucket.

    ``key`` and ``digest`` tell which super-window a string was cut from.
    """

    def settle(bucket: list[tuple[int, int, int, int, int, list[bytes]]]) -> list[tuple[int, ...]]:
        windows = []
        for key, digest, doc, text_key, first, words in bucket:
            for i in range(len(words) - window + 1):
                windows.append((words[i : i + window], doc, text_key, first + i, key, digest))
        windows.sort()
        found, earliest, before = [], None, None
        for words, doc, text_key, at, key, digest in windows:
            if words != before:
                before, earliest = words, doc  # the first of equal windows has the smallest document
            elif doc > earliest:
                found.append((key, digest, doc, text_key, at, at + window))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["key", "digest", "doc", "text_key", "start", "stop"]
            )

        at, bucket, found = None, [], []
        for batch in pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("bucket", "key", "digest", "doc", "text_key", "first", "packed")]
            for place, *row, text in zip(*columns, strict=True):
                if place != at:
                    if len(bucket) > 1:
                        found += settle(bucket)
                    at, bucket = place, []
                bucket.append((*row, text.split()))
            if found:
                yield flushed(found)
                found = []
        if len(bucket) > 1 and (found := settle(bucket)):
            yield flushed(found)

    # the words of a bucket: at most BUCKET strings
    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def _by_cores(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """The strings cut to the windows whose minimiser lies in one part of the window, in a bucket for each core of such windows.

    ``low`` and ``high`` bound the place of the minimiser in a window. They are split in two (in ``INTERVALS`` at the start), and all windows
    of a half share the words from the start of its last window to the end of its first one. Equal windows have
    equal places and equal cores, so they meet again. ``part`` is a digest of what is left of a string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 1_000_000):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "low", "high", "key", "digest", "doc", "text_key", "first", "packed")]
            for bucket, low, high, key, digest, doc, text_key, first, text in zip(*columns, strict=True):
                words = text.split()
                most = int(super_windows(word_symbols(words), window, gram)[1][0])
                least = most - (len(words) - window)
                steps = INTERVALS if (low, high) == (0, window - gram + 1) else 2
                edges = np.unique(np.linspace(low, high, steps + 1).astype(int)).tolist()
                for a, b in zip(edges, edges[1:], strict=False):
                    near, far = max(a, least), min(b - 1, most)
                    if near <= far:
                        core = b" ".join(words[most - a : most - b + 1 + window])
                        place = xxhash.xxh3_64_intdigest(core, (bucket * 64 + a) % (1 << 64))
                        cut_out = b" ".join(words[most - far : most - near + window])
                        part = xxhash.xxh3_64_intdigest(cut_out, 1)
                        rows.append((place - (1 << 63), part - (1 << 63), a, b, key, digest, doc, text_key, first + most - far, far - near + window, cut_out))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["bucket", "part", "low", "high", "key", "digest", "doc", "text_key", "first", "words", "packed"],
                )

    return strings.mapInArrow(
        run, "bucket bigint, part bigint, low int, high int, key bigint, digest bigint, doc bigint, text_key bigint, first int, words int, packed binary"
    )


def _in_crowds(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """The same as ``_in_buckets`` for buckets of any size: they are split by longer and longer cores until each holds ``BUCKET`` strings.

    Of the strings of a bucket that have become equal, those of later documents are repeats as a whole and go; a bucket
    whose strings are all equal is settled. A core of a whole window leaves no others, so the splitting ends, after the
    halvings of a window at most. A string makes ``INTERVALS`` rows in the first split and one for each half that
    still shares its core with others in those that follow.
    """
    columns = [c.split()[0] for c in _STRING.split(", ")]
    found = []
    open_ones = strings.withColumn("low", F.lit(0)).withColumn("high", F.lit(window - gram + 1))
    while not open_ones.isEmpty():
        rows = cut(_by_cores(open_ones, window, gram), "cores")
        parts = cut(rows.groupBy("bucket", "part").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "parts")
        sizes = parts.groupBy("bucket").agg(F.count("*").alias("variants"), F.sum("n").alias("strings"))
        sizes = cut(sizes.where("strings > 1"), "part-sizes")
        held = rows.join(parts.drop("n"), ["bucket", "part"]).join(sizes, "bucket")
        held = cut(held, "held")
        whole = held.where("doc > least")
        found.append(whole.select("key", "digest", "doc", "text_key", F.col("first").alias("start"), (F.col("first") + F.col("words")).alias("stop")))
        rest = held.where("doc = least and variants > 1").drop("strings")
        left = cut(rest.groupBy("bucket").agg(F.count("*").alias("strings")), "left")
        # only equal digests of different cores leave strings that differ in a bucket of whole windows
        crowded = (F.col("strings") > BUCKET) & (F.col("high") - F.col("low") > 1)
        rest = rest.join(left, "bucket")
        found.append(_in_buckets(rest.where(~crowded).select(*columns), window))
        open_ones = cut(rest.where(crowded).select(*columns, "low", "high"), "open")
    out = found[0] if found else None
    for more in found[1:]:
        out = out.unionByName(more)
    return out if out is not None else strings.sparkSession.createDataFrame([], _FOUND)


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc, text_key, spans)``: word spans ``[start, stop)`` covered by a window whose words also start in a document with a smaller id.

    Consecutive windows that share a minimiser (the smallest hash of ``gram`` words) form a super-window. Equal windows have
    equal minimisers, so they lie in super-windows of one key. Super-windows first travel as key and digest. Those equal to one
    of an earlier document are repeats as a whole; of the others with a shared key, one for each digest travels as a packed
    string to the key's bucket, where sorting its windows finds the first document of each. Buckets with more than ``BUCKET``
    different strings are first split by the words that their windows share. What is found for a string holds at every
    other place of its digest in the same document too.

    Null texts have no words. Rows that share an id are no repeats of each other; a null id comes after all others. Texts under
    ``window`` words have no window. The digest of a super-window has 64 bits beside the 64 bits of its key.
    """
    rows = cut(_super_windows(docs, window, gram), "super-windows")
    keys = rows.groupBy("key").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), (F.min("digest") != F.max("digest")).alias("varied")
    )
    shared = cut(keys.where("least < most").select("key", "varied"), "shared")
    met = cut(rows.join(shared, "key"), "met")
    one = met.groupBy("key", "digest").agg(
        F.min(F.struct("doc", "text_key", "first", "n")).alias("one"), F.count("*").alias("copies"), F.first("varied").alias("varied")
    )
    one = cut(one, "variants")
    several = one.where("copies > 1").select(
        "key", "digest", F.col("one.doc").alias("least"), F.col("one.text_key").alias("one_key"), F.col("one.first").alias("one_first")
    )
    again = met.join(several, ["key", "digest"]).where("doc > least or varied and (text_key != one_key or first != one_first)")
    again = cut(again.drop("varied"), "again")
    whole = again.where("doc > least").select("doc", "text_key", F.col("first").alias("start"), (F.col("first") + F.col("n") + (window - 1)).alias("stop"))

    varied = one.where("varied")
    sizes = cut(varied.groupBy("key").agg(F.count("*").alias("variants")), "sizes")
    wanted = varied.join(sizes, "key").select("key", "digest", "one.*", "variants")
    packed = cut(_packed(docs, wanted, window).join(sizes, "key").dropDuplicates(["key", "doc", "text_key", "first"]), "packed")
    strings = packed.withColumn("bucket", F.col("key"))
    columns = [c.split()[0] for c in _STRING.split(", ")]
    small = _in_buckets(strings.where(F.col("variants") <= BUCKET).select(*columns), window)
    large = _in_crowds(strings.where(F.col("variants") > BUCKET).select(*columns), window, gram)
    found = cut(small.unionByName(large), "found")
    # the windows of a super-window overlap, so what is found in it is one span
    joined = found.groupBy("key", "digest").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    moved = F.col("first") - F.col("one_first")
    twins = again.where("doc = least").join(joined, ["key", "digest"])
    twins = twins.select("doc", "text_key", (F.col("start") + moved).alias("start"), (F.col("stop") + moved).alias("stop"))
    spans = whole.unionByName(found.select("doc", "text_key", "start", "stop")).unionByName(twins)
    return spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: the words of every row that stay, joined by single blanks."""
    spans = cut(repeated_words(docs, window, gram), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, removed, kept = [], [], []
            for text, parts in zip(bytes_of(batch), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for p in parts or ():
                    gone[p["start"]] += 1
                    gone[p["stop"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                n.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc", "n_words", "n_removed", "kept"],
            )

    held = ordered(docs).join(spans.hint("merge"), ["doc", "text_key"], "left").select("doc", "text", "spans")
    out = held.mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(_as_id("doc").alias("doc_id"), "n_words", "n_removed", "kept")


def _as_id(doc: str) -> Column:
    return F.when(F.col(doc) != LAST, F.col(doc))
