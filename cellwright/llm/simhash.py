"""SimHash near duplicates: Golay-code keys of fingerprint segments, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, cut, pieces, with_key, without
from .graph import components

SHINGLE_WORDS = 3
#: Buckets up to this size are verified pair by pair, larger ones through shared midpoints.
PAIR_BUCKET = 8

# Fixed values of the binary Golay code of length 23: its generator polynomial and its sizes.
GENERATOR, LENGTH, CHECK_BITS = 0b110001110101, 23, 11


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits; a bit is set when over half of the shingles' hashes have it. 0 for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle_words + 1)
    spans = list(zip(starts[:last].tolist(), ends[min(shingle_words, len(words)) - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 15):
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in spans[at : at + (1 << 15)]], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, text_key, fp)``, ``fp`` as a signed BIGINT; one row per row of ``docs``, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in bytes_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_key(docs).mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words, and for each syndrome the one error of at most three bits that has it."""
    syndromes = np.zeros(1, np.uint16)
    for bit in range(LENGTH):
        rest = 1 << bit
        for high in range(LENGTH - 1, CHECK_BITS - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - CHECK_BITS)
        syndromes = np.concatenate((syndromes, syndromes ^ np.uint16(rest)))
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(LENGTH), n):
            error = sum(1 << b for b in bits)
            errors[syndromes[error]] = error
    return syndromes, errors


def golay_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each 23-bit word the indices of the codewords nearest to it and to its 23 neighbours: a row of 24, with repeats.

    Two words at most two bits apart have a common word at most one bit from both, so they share a key.
    """
    syndromes, errors = tables
    near = words[:, None] ^ np.concatenate(([0], 1 << np.arange(LENGTH)))[None, :]
    return (near ^ errors[syndromes[near]]) >> CHECK_BITS


def bucket_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(position in fps, key)``: each segment taken exactly, with the Golay keys of the segment after it.

    Of three segments, two wrong bits leave one untouched, and the next one has at most two wrong bits.
    """
    u = fps.view(np.uint64)
    segments = [(u >> np.uint64(shift) & np.uint64(mask)).astype(np.int64) for shift, mask in ((42, 0x3FFFFF), (21, 0x1FFFFF), (0, 0x1FFFFF))]
    rows, keys = [], []
    for i in range(3):
        near = np.sort(golay_keys(segments[(i + 1) % 3], tables), axis=1)
        fresh = np.concatenate((np.ones((len(u), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        row, column = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(i) << 36) | (segments[i][row] << 12) | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)`` with ``a < b``: fingerprints at most two bits apart. Not all pairs, but pairs that connect all of them.

    ``fps`` has distinct fingerprints. Buckets of up to ``PAIR_BUCKET`` are verified pair by pair. The fingerprints of larger
    ones are joined on the 65 words at most one bit away: two of them share such a word exactly when they are at most two
    bits apart, so a star around each word's smallest member loses no connection and grows in proportion to the bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in pieces(batches, 200_000):
            fp = batch.column("fp").to_numpy()
            row, key = bucket_keys(fp, tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    keys = cut(fps.select("fp").mapInArrow(run, "key bigint, fp bigint"), "keys")
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = cut(keys.join(shared, "key"), "members")

    small = members.where(F.col("n") <= PAIR_BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    close = F.flatten(
        F.transform(
            "fps",
            lambda a, i: F.transform(
                F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= 2)), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    pairs = small.select(F.inline(close)).distinct()

    large = members.where(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)])
    near = cut(large.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")), "words")
    stars = cut(near.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a"), "stars")
    around = near.join(stars, "word").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(around).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, text_key, fp, component_id, component_key)`` for every row of ``docs``.

    Documents are linked when their fingerprints differ in at most two bits; ``component_id`` is the smallest ``doc_id`` that
    links reach (null ids last), and ``component_key`` the text key of that document. A null text counts as empty; empty
    texts share fingerprint 0 and are linked like any others. Equal fingerprints meet only as one, so a group of copies costs
    a row per task; attaching the result to the documents is a join that Spark can split. Repeated rows get one result.
    """
    rows = cut(fingerprints(docs, shingle_words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    fps = cut(rows.groupBy("fp").agg(first), "fps")
    joined = components(links(fps))
    roots = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots, "roots")
    firsts = roots.groupBy("root").agg(F.min("first").alias("first"))
    result = cut(roots.select("fp", "root").join(cut(firsts, "firsts"), "root").select("fp", "first"), "components")
    return rows.join(result, "fp").select(
        "doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("component_key")
    )


def keep_representatives(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``."""
    found = near_duplicates(docs, shingle_words)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    return without(docs, found.select("doc_id", "text_key", stays.alias("kept")))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
