"""Phrase collocations by SON partitioning: shards are mined at lowered support, what any shard finds is counted exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bytes_of, cut, pieces
from .minimisers import mixed

LEAST, SHARDS, TOP = 10, 2, 2000
#: Copies of a part's count, over which the candidates that share the part are spread.
SALTS = 8
#: Most bits of the map of locally frequent phrases, 32 MB; where it fills up, more phrases are counted than needed.
FILTER_BITS = 1 << 28
BATCH_BYTES = 4_000_000
#: Longer words are hashed one by one.
LONG_WORD = 64
#: Hashes with counts that a task gathers before it hands them on.
GATHERED = 1_000_000

# every piece end becomes a full stop, tabs become blanks
_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"." * 10 + b" ")
_TURN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _TURN)
_BYTES[[0x20, 0x2E]] = 0
_POWERS = np.cumprod(np.full(LONG_WORD, _STEP))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, chunk: int = 100_000) -> np.ndarray:
    """A hash for each word: its bytes' numbers times powers by place, summed; ``chunk`` words at a time bound the memory."""
    import xxhash

    buffer = np.frombuffer(data, np.uint8)
    sums = [np.empty(0, np.uint64)]
    for at in range(0, len(starts), chunk):
        first = starts[at : at + chunk]
        stop = ends[min(at + chunk, len(starts)) - 1]
        here = first - first[0]
        place = np.arange(stop - first[0]) - np.repeat(here, np.diff(here, append=stop - first[0]))
        sums.append(np.add.reduceat(_BYTES[buffer[first[0] : stop]] * _POWERS[np.minimum(place, LONG_WORD - 1)], here))
    lengths = ends - starts
    h = mixed(np.concatenate(sums) + lengths.astype(np.uint64) * _TURN)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


class Batch:
    """The words of a batch of documents in a row: their places and hashes, with language and shard."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        import xxhash

        texts = bytes_of(batch)
        self.data = b".".join([*texts, b""]).lower().translate(_BREAKS)
        buffer = np.frombuffer(self.data, np.uint8)
        stop = buffer == 0x2E
        gap = stop | (buffer == 0x20)
        edges = np.flatnonzero(np.diff(gap, prepend=True))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.size = len(self.starts)
        pieces_before = np.cumsum(stop, dtype=np.int32)
        self.joined = pieces_before[self.starts[1:]] == pieces_before[self.ends[:-1]]
        self.joined &= ~stop[self.ends[:-1]]
        self.symbols = word_hashes(self.data, self.starts, self.ends)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, "right")
        langs = batch.column("lang").to_pylist()
        self.lang_names = sorted(set(langs))
        code = {x: i for i, x in enumerate(self.lang_names)}
        self.lang = np.array([code[x] for x in langs], np.int32)[doc]
        self.seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 7) for x in self.lang_names], np.uint64)[self.lang]
        self.shard = batch.column("shard").to_numpy().astype(np.uint64)[doc]

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all phrases of ``n`` words, and a hash of language and words for each."""
        size = self.size - n + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        inside = np.ones(size, bool)
        for k in range(n - 1):
            inside &= self.joined[k : k + size]
        first = np.flatnonzero(inside)
        h = self.seeds[first]
        for k in range(n):
            h = mixed((h ^ self.symbols[first + k]) * _TURN + np.uint64(n))
        return first, h

    def spelled(self, first: np.ndarray, n: int) -> list[bytes]:
        """The ``n`` words from each of ``first`` on, joined by single blanks."""
        starts, ends = self.starts[first], self.ends[first + n - 1]
        lengths = sum((self.ends[first + k] - self.starts[first + k] for k in range(n)), np.full(len(first), n - 1))
        out = [self.data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for i in np.flatnonzero(ends - starts != lengths).tolist():  # more than a blank between words
            out[i] = b" ".join(out[i].split())
        return out


def in_shard(h: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    """The hash of a phrase in a shard."""
    return mixed(h + (np.atleast_1d(shard).astype(np.uint64) + np.uint64(1)) * _STEP)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of the hashes are set; the number of bits is a power of two."""
    mask = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(h), bool)
    for spot in (h & mask, h >> np.uint64(32) & mask):
        found &= (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def shard_texts(docs: DataFrame, shards: int) -> DataFrame:
    """``(lang, text, shard)``: null languages are ``und``, null texts empty; shards go by a hash of id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(shards)).alias("shard")
    )


def _mined(texts: DataFrame, sizes: tuple[int, ...], support: int, allowed: Callable[[Batch, np.ndarray], np.ndarray] | None) -> DataFrame:
    """``h``: hashes of the phrases of ``sizes`` words that occur ``support`` times in one shard, as hashed by ``in_shard``.

    A shard is spread over as many tasks as its texts need; its counts meet by hash in a shuffle after a count per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            h, f = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h)
            h, f = h[order], f[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(f, first))], ["h", "f"])

        for part in pieces(batches, BATCH_BYTES):
            batch = Batch(part)
            for n in sizes:
                first, h = batch.phrases(n)
                if allowed is not None:
                    keep = allowed(batch, first)
                    first, h = first[keep], h[keep]
                if len(h):
                    held.append(np.unique(in_shard(h, batch.shard[first]), return_counts=True))
            if sum(len(x) for x, _ in held) > GATHERED:
                yield flushed()
        if held:
            yield flushed()

    counted = texts.mapInArrow(run, "h bigint, f bigint").groupBy("h").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= support).select("h")


def _bitmap(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A map with two bits of every hash set, 16 bits a hash and ``most_bits`` at most; a number for each 64 bits reaches the driver."""
    hashes = cut(hashes, "frequent")
    n_bits = min(most_bits, 1 << max(6, (16 * hashes.count()).bit_length()))
    spots = hashes.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(n_bits - 1)).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    rows = words.toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def _counted(texts: DataFrame, wanted: Callable[[int, np.ndarray], np.ndarray], sizes: tuple[int, ...]) -> DataFrame:
    """``(lang, phrase, n_words, f)``: exact counts of all wanted phrases, by their words, and of all words as a phrase of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BATCH_BYTES):
            batch = Batch(part)
            # all words of each language, as a phrase of none
            totals = np.bincount(batch.lang, minlength=len(batch.lang_names))
            langs, lengths, counts = [np.arange(len(totals))], [np.zeros(len(totals), np.int32)], [totals]
            phrases = [pa.array([""] * len(totals), pa.string())]
            for n in sizes:
                starts, h = batch.phrases(n)
                keep = wanted(n, h)
                starts, h = starts[keep], h[keep]
                _, first, f = np.unique(h, return_index=True, return_counts=True)
                starts = starts[first]
                langs.append(batch.lang[starts])
                phrases.append(pa.array(batch.spelled(starts, n), pa.binary()).cast(pa.string()))
                lengths.append(np.full(len(starts), n, np.int32))
                counts.append(f)
            names = pa.array(batch.lang_names, pa.string()).take(pa.array(np.concatenate(langs)))
            yield pa.RecordBatch.from_arrays(
                [names, pa.concat_arrays(phrases), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(counts))], ["lang", "phrase", "n_words", "f"]
            )

    found = texts.mapInArrow(run, "lang string, phrase string, n_words int, f bigint")
    return found.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f"))


def candidates(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(lang, phrase, n_words, f)``: the words and phrases of 2 and 3 words that occur ``least`` times in their language.

    All words of a language are counted as an empty phrase of 0 words.

    SON: the documents are dealt to ``shards`` shards, and a phrase with ``least`` occurrences has at least ``least / shards``, rounded up, in
    one of them. Every shard is mined completely at that support, level by level: words and pairs first, then those triples
    whose two pairs are frequent in the same shard. What any shard found is counted over all documents by its words.
    The shards' findings are kept as bits of hashes, which can only let more phrases into the exact count.

    The support is a count, not a share, so more shards would lower it to where nothing is pruned: there are few of them, and each
    is mined by as many tasks as it needs.
    """
    spark = docs.sparkSession
    texts = shard_texts(docs, shards)
    support = -(-least // shards)
    short = spark.sparkContext.broadcast(_bitmap(_mined(texts, (1, 2), support, None), filter_bits))

    def both_pairs(batch: Batch, first: np.ndarray) -> np.ndarray:
        at, h = batch.phrases(2)
        frequent = np.zeros(batch.size + 1, bool)
        frequent[at] = marked(short.value, in_shard(h, batch.shard[at]))
        return frequent[first] & frequent[first + 1]

    triples = spark.sparkContext.broadcast(_bitmap(_mined(texts, (3,), support, both_pairs), filter_bits))

    def in_any_shard(n: int, h: np.ndarray) -> np.ndarray:
        bits = (triples if n == 3 else short).value
        found = np.zeros(len(h), bool)
        for shard in range(shards):
            found |= marked(bits, in_shard(h, shard))
        return found

    return _counted(texts, in_any_shard, (1, 2, 3)).where((F.col("f") >= least) | (F.col("n_words") == 0))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, shards: int = SHARDS, salts: int = SALTS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language by score, count and spelling.

    ``candidates`` finds the phrases of 2 and 3 words by SON partitioning. A candidate is scored at each cut by a * a / (l * r) in
    exact decimals, the lowest score counts; pairs that stand inside a triple at least half as frequent are dropped.
    Null texts are empty, null languages ``und``; repeated rows count each time; texts of any length are read whole. An empty
    table gives no rows; other columns than doc_id, text and lang are never read.
    """
    # parts of a candidate occur at least as often as it does
    counts = cut(candidates(docs, least, shards), "phrases")
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    frequent = counts.where("n_words > 0")
    found = frequent.where("n_words > 1").withColumn("words", F.split("phrase", " "))

    triples = found.where("n_words = 3").select("lang", "f", F.explode(F.array(*[F.array_join(F.slice("words", i, 2), " ") for i in (1, 2)])).alias("phrase"))
    longer = triples.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where("longer is null or n_words = 3 or 100 * longer < 50 * f")

    k = F.col("k")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"),
        F.array_join(F.slice("words", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("words", k + 1, F.col("n_words") - k), " ").alias("tail"),
    )
    # many candidates share a part: its count goes to every salt
    parts = frequent.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", "salt", F.col("part").alias(part), F.col("f").alias(name)), ["lang", "salt", part])
    whole = "cast({} as decimal(15,0))".format
    score = F.expr(f"({whole('a')} * {whole('a')} * cast(1000000 as decimal(7,0))) div ({whole('l')} * {whole('r')})")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
