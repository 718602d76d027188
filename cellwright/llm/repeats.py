"""Repeated byte strings: super-windows meet by their minimisers, suffix arrays find what differing ones share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, cut, pieces
from .minimisers import super_windows
from .substrings import _as_id, ordered
from .suffixes import suffix_array

WINDOW, GRAM = 400, 32
#: Keys with more different super-windows than this are split by what their windows have in common.
CROWD = 400
#: Parts of such a key with up to this many strings get a suffix array, larger ones are counted window by window.
BUCKET = 4000
#: Intervals of a window's place around the minimiser, by which a crowded key is split.
INTERVALS = 8

_ROW = "doc bigint, text_key bigint, key bigint, digest bigint, first int, place int, n int"


def _super_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches):
            at, keys, digests, firsts, places, counts = [], [], [], [], [], []
            for i, text in enumerate(bytes_of(batch)):
                if len(text) < window:
                    continue
                key, place, first, last = super_windows(np.frombuffer(text, np.uint8), window, gram)
                at.append(np.full(len(key), i))
                keys.append(key.view(np.int64))
                spans = zip(first.tolist(), (last + window).tolist(), strict=True)
                digests.append(np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in spans], np.uint64).view(np.int64))
                firsts.append(first)
                places.append(place)
                counts.append(last - first + 1)
            if at:
                rows = pa.array(np.concatenate(at))
                numbers = [(keys, pa.int64()), (digests, pa.int64()), (firsts, pa.int32()), (places, pa.int32()), (counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(rows), batch.column("text_key").take(rows), *[pa.array(np.concatenate(x), t) for x, t in numbers]],
                    ["doc", "text_key", "key", "digest", "first", "place", "n"],
                )

    return ordered(docs).mapInArrow(run, _ROW)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def _reach(contexts: list[bytes]) -> list[int]:
    """For each context the longest prefix that it shares with another; the best one is its neighbour in sorted order."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    longest = [0] * len(contexts)
    for i, j in zip(order, order[1:]):  # noqa: B905
        n = common_prefix(contexts[i], contexts[j])
        longest[i], longest[j] = max(longest[i], n), max(longest[j], n)
    return longest


def repeated_starts(strings: list[bytes], window: int) -> list[set[int]]:
    """For each string the starts of windows that also start elsewhere in the strings, by the suffix array of all of them.

    Each string ends in a symbol of its own, so equal windows are neighbours among the suffixes that hold a whole window.
    """
    symbols: list[int] = []
    owner, ends = [], []
    for i, s in enumerate(strings):
        symbols += s
        symbols.append(-1 - i)
        owner += [i] * (len(s) + 1)
        ends.append(len(symbols) - 1)
    text = b"\0".join(strings)
    found: list[set[int]] = [set() for _ in strings]
    before = last = None
    for at in suffix_array(symbols):
        i = owner[at]
        if ends[i] - at < window:
            continue
        now = text[at : at + window]
        if now == before:
            for x in (last, at):
                found[owner[x]].add(x - (ends[owner[x]] - len(strings[owner[x]])))
        before, last = now, at
    return found


def shared_spans(bucket: list[tuple], window: int) -> list[tuple[int, int, int, int]]:
    """Spans ``(doc, text_key, start, stop)`` of a key's super-windows ``(doc, text_key, first, place, copies, bytes)`` that repeat.

    Every window of the key holds its minimiser at ``place``, so a window that repeats lies within the longest contexts
    before and after it that its super-window shares with others. Super-windows are trimmed to those; when the rest
    equals another's rest, all of its windows repeat. Where rests differ, a suffix array finds the windows they share.
    """
    lefts = _reach([text[: place - first + 1][::-1] for _, _, first, place, _, text in bucket])
    rights = _reach([text[place - first :] for _, _, first, place, _, text in bucket])
    rests: dict[bytes, list[tuple[int, int, int, int]]] = {}
    for (doc, text_key, first, place, copies, text), left, right in zip(bucket, lefts, rights, strict=True):
        if left and left + right - 1 >= window:
            start = place - left + 1
            rests.setdefault(text[start - first : place - first + right], []).append((doc, text_key, start, copies))
    found = []
    open_rests = False
    for rest, owners in rests.items():
        if len(owners) > 1:
            found += [(doc, key, start, start + len(rest)) for doc, key, start, copies in owners if copies == 1]
        elif owners[0][3] == 1:
            open_rests = True
    if open_rests and len(rests) > 1:
        for starts, (_, owners) in zip(repeated_starts(list(rests), window), rests.items(), strict=True):
            if len(owners) == 1 and owners[0][3] == 1:
                doc, key, start, _ = owners[0]
                found += [(doc, key, start + a, start + b + window) for a, b in runs(sorted(starts))]
    return found


def runs(numbers: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    out: list[list[int]] = []
    for x in numbers:
        if out and x == out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


def _packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "variants", "doc", "text_key", "first", "place", "copies", "packed")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        for batch in pieces(batches):
            rows = []
            for doc, text_key, text, parts in zip(
                batch.column("doc").to_pylist(), batch.column("text_key").to_pylist(), bytes_of(batch), batch.column("spans").to_pylist(), strict=True
            ):
                for p in parts:
                    packed = text[p["first"] : p["first"] + p["n"] + window - 1]
                    rows.append((p["key"], p["variants"], doc, text_key, p["first"], p["place"], p["copies"], packed))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    spans = wanted.groupBy("doc", "text_key").agg(F.collect_list(F.struct("key", "variants", "first", "place", "n", "copies")).alias("spans"))
    # both sides grow with the corpus; one plan at every size
    held = ordered(docs).join(spans.hint("merge"), ["doc", "text_key"])
    made = held.mapInArrow(run, "key bigint, variants bigint, doc bigint, text_key bigint, first int, place int, copies bigint, packed binary")
    return made.dropDuplicates(["key", "doc", "text_key", "first"])


def _split(packed: DataFrame, window: int, gram: int) -> DataFrame:
    """Crowded keys in parts: equal windows have equal places around the minimiser, and all windows whose place lies in one of
    ``INTERVALS`` intervals share a core of almost a window. A super-window goes to the part of each core it holds, cut to the
    windows of that interval, so it makes ``INTERVALS`` rows at most.
    """
    edges = np.linspace(0, window - gram + 1, INTERVALS + 1).astype(int).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 1_000_000):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("key", "doc", "text_key", "first", "place", "copies", "packed")]
            for key, doc, text_key, first, place, copies, text in zip(*columns, strict=True):
                most = place - first
                least = most - (len(text) - window)
                for i in range(INTERVALS):
                    low, high = max(edges[i], least), min(edges[i + 1] - 1, most)
                    if low <= high:
                        core = text[most - edges[i] : most - (edges[i + 1] - 1) + window]
                        part = xxhash.xxh3_64_intdigest(core, (key * INTERVALS + i) % (1 << 64))
                        at = most - high
                        rows.append((part - (1 << 63), doc, text_key, first + at, place, copies, text[at : most - low + window]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["key", "doc", "text_key", "first", "place", "copies", "packed"],
                )

    return packed.mapInArrow(run, "key bigint, doc bigint, text_key bigint, first int, place int, copies bigint, packed binary")


def _in_buckets(packed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(found: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc", "text_key", "start", "stop"])

        key, bucket = None, []
        for batch in pieces(batches):
            found = []
            for k, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "doc", "text_key", "first", "place", "copies", "packed")], strict=True):
                if k != key:
                    found += shared_spans(bucket, window) if len(bucket) > 1 else []
                    key, bucket = k, []
                bucket.append(tuple(row))
            if found:
                yield flushed(found)
        if len(bucket) > 1 and (found := shared_spans(bucket, window)):
            yield flushed(found)

    # a bucket holds at most BUCKET strings of under two windows each
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc bigint, text_key bigint, start int, stop int")


def _window_by_window(packed: DataFrame, window: int) -> DataFrame:
    """The same for keys of any size: 128-bit digests of the windows are counted in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 100_000):
            rows, halves, starts = [], [], []
            for i, (first, text) in enumerate(zip(batch.column("first").to_pylist(), batch.column("packed").to_pylist(), strict=True)):
                n = len(text) - window + 1
                rows.append(np.full(n, i))
                starts.append(np.arange(first, first + n))
                halves.append(b"".join([xxhash.xxh3_128_digest(text[a : a + window]) for a in range(n)]))
            high_low = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("doc", "text_key", "copies")], pa.array(high_low[:, 0].copy()), pa.array(high_low[:, 1].copy()), pa.array(np.concatenate(starts), pa.int32())],
                ["doc", "text_key", "copies", "high", "low", "start"],
            )

    windows = cut(packed.mapInArrow(run, "doc bigint, text_key bigint, copies bigint, high bigint, low bigint, start int"), "windows")
    twice = cut(windows.groupBy("high", "low").count().where("count > 1").select("high", "low"), "twice")
    return windows.where("copies = 1").join(twice, ["high", "low"]).select("doc", "text_key", "start", (F.col("start") + window).alias("stop"))


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc, text_key, spans)``: byte spans ``[start, stop)`` covered by a string of ``window`` bytes that also starts elsewhere.

    Equal windows have equal minimisers (the smallest hash of ``gram`` bytes), so they lie in super-windows, runs of windows with
    one minimiser, of one key. Super-windows first travel as key and digest. One that occurs twice repeats as a whole. Where
    a key has different ones, each travels once, as bytes, to its key's bucket, where a suffix array finds the windows
    they share. Keys with more than ``CROWD`` different super-windows are first split by the cores that their windows share,
    and parts of more than ``BUCKET`` strings are counted window by window in a shuffle, with the same result; so no
    key, however common, gathers in one task.

    Matches never cross rows. Null texts are empty; texts under ``window`` bytes have no window; repeated rows repeat each other.
    The digest of a super-window has 64 bits beside the 64 bits of its key.
    """
    rows = cut(_super_windows(docs, window, gram), "super-windows")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("varied"))
    shared = cut(keys.where("n > 1").select("key", "varied"), "shared")
    met = cut(rows.join(shared, "key"), "met")
    one = met.groupBy("key", "digest").agg(
        F.min(F.struct("doc", "text_key", "first", "place", "n")).alias("one"), F.count("*").alias("copies"), F.first("varied").alias("varied")
    )
    one = cut(one, "variants")
    twice = met.join(one.where("copies > 1").select("key", "digest"), ["key", "digest"])
    whole = twice.select("doc", "text_key", F.col("first").alias("start"), (F.col("first") + F.col("n") + (window - 1)).alias("stop"))

    varied = one.where("varied")
    # a key whose super-windows all occur twice has nothing left to find
    sizes = cut(varied.groupBy("key").agg(F.count("*").alias("variants"), F.min("copies").alias("least")).where("least = 1").drop("least"), "sizes")
    wanted = varied.join(sizes, "key").select("key", "one.*", "copies", "variants")
    packed = cut(_packed(docs, wanted, window), "packed")
    small = _in_buckets(packed.where(F.col("variants") <= CROWD), window)
    parts = cut(_split(packed.where(F.col("variants") > CROWD), window, gram), "parts")
    crowds = parts.groupBy("key").agg(F.count("*").alias("variants"), F.min("copies").alias("least")).where("variants > 1 and least = 1")
    parts = cut(parts.join(cut(crowds.drop("least"), "crowds"), "key"), "crowded")
    medium = _in_buckets(parts.where(F.col("variants") <= BUCKET), window)
    large = _window_by_window(parts.where(F.col("variants") > BUCKET), window)
    spans = whole.unionByName(small).unionByName(medium).unionByName(large)
    return spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: the bytes of every row that stay, and the number of runs removed."""
    spans = cut(repeated_bytes(docs, window, gram), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, removed, n_runs, kept = [], [], [], []
            for text, parts in zip(bytes_of(batch), batch.column("spans").to_pylist(), strict=True):
                out, at, gone, count = [], 0, 0, 0
                for start, stop in sorted((p["start"], p["stop"]) for p in parts or ()):
                    if start > at or not count:
                        out.append(text[at:start])
                        count += 1
                        gone += stop - start
                        at = stop
                    elif stop > at:
                        gone += stop - at
                        at = stop
                out.append(text[at:])
                n.append(len(text))
                removed.append(gone)
                n_runs.append(count)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(x, pa.int64()) for x in (n, removed, n_runs)], pa.array(kept, pa.binary())],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    held = ordered(docs).join(spans.hint("merge"), ["doc", "text_key"], "left").select("doc", "text", "spans")
    out = held.mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(_as_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
