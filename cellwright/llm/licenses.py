"""License scans: rare words of the files meet a positional index of license notices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, documents, pieces
from .search import terms_of

#: Fixed values of the contract: phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label, each with the phrases that must stand in a place taken for it.
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache license", "in compliance with the license"),
    ),
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "is hereby granted"),
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        ("under the terms of the gnu general public license",),
    ),
    (
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        ("lesser general public license",),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "released under creative commons zero cc0 public domain dedication", ("public domain dedication",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
]

#: Rare words looked up for a file, words that have to agree on a place, tolerance of relative positions, least share of a notice.
RARE_WORDS, AGREEING, DRIFT, LEAST_SHARE = 12, 2, 4, 0.6


class NoticeIndex:
    """Words of the notices by number, and for each word its places ``(notice, position)``."""

    def __init__(self, notices: list[tuple[str, str, tuple[str, ...]]] = NOTICES, base: dict[str, str] = BASE) -> None:
        split = lambda text: terms_of(text.encode())
        self.labels = [label for label, _, _ in notices]
        texts = [split(text) for _, text, _ in notices]
        phrases = [[split(p) for p in wanted] for _, _, wanted in notices]
        told = [split(p) for p in base]
        words = sorted({w for seq in (*texts, *told, *(p for ps in phrases for p in ps)) for w in seq})
        self.number = {w: i for i, w in enumerate(words)}
        ids = lambda seq: [self.number[w] for w in seq]
        self.notices = [ids(t) for t in texts]
        self.phrases = [[ids(p) for p in ps] for ps in phrases]
        self.needed = [{w for p in ps for w in p} for ps in self.phrases]
        self.base = [(ids(p), label) for p, label in zip(told, base.values(), strict=True)]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, notice in enumerate(self.notices):
            for at, w in enumerate(notice):
                self.places.setdefault(w, []).append((t, at))

    @property
    def words(self) -> list[bytes]:
        return list(self.number)


def phrase_starts(at: dict[int, np.ndarray], phrase: list[int]) -> np.ndarray:
    """Places where the words of ``phrase`` stand consecutively, from the sorted places ``at`` of each word."""
    none = np.empty(0, np.int64)
    starts = at.get(phrase[0], none)
    for k, word in enumerate(phrase[1:], 1):
        starts = starts[np.isin(starts + k, at.get(word, none), assume_unique=True)]
    return starts


def near(places: np.ndarray, wanted: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each of ``wanted`` whether a place lies in ``[wanted + low, wanted + high]``."""
    return np.searchsorted(places, wanted + low, "left") < np.searchsorted(places, wanted + high, "right")


def notices_found(at: dict[int, np.ndarray], index: NoticeIndex, idf: list[float]) -> dict[str, float]:
    """Labels of the notices that stand in a file, each with the share of the notice's words found in their places.

    Of the file's license words the ``RARE_WORDS`` with the highest weight are looked up. Each place of such a word, less its position in
    a notice, is a place where the notice may start; one on which ``AGREEING`` different words agree within ``DRIFT`` is a
    candidate. There every mandatory phrase has to stand whole, and ``LEAST_SHARE`` of the words near their positions.
    """
    rare = sorted(at, key=lambda w: (-idf[w], w))[:RARE_WORDS]
    starts: dict[int, list[tuple[np.ndarray, int]]] = {}
    # a file without a word of a mandatory phrase can't hold the phrase
    possible = {t for t, needed in enumerate(index.needed) if needed <= at.keys()}
    for w in rare if possible else ():
        for t, position in index.places.get(w, ()):
            if t in possible:
                starts.setdefault(t, []).append((at[w] - position, w))
    found: dict[str, float] = {}
    for t, votes in starts.items():
        if len({w for _, w in votes}) < min(AGREEING, len(set(index.notices[t]))):
            continue
        # two grids, half a cell apart: places within DRIFT share a cell of one of them
        where = np.concatenate([s for s, _ in votes])
        who = np.concatenate([np.full(len(s), w) for s, w in votes])
        spots = []
        for shift in (0, DRIFT):
            cell = (where + shift) // (2 * DRIFT)
            pairs = np.unique(np.stack([cell, who]), axis=1)
            cells, words = np.unique(pairs[0], return_counts=True)
            spots.append(cells[words >= AGREEING] * (2 * DRIFT) - shift + DRIFT)
        spots = np.unique(np.concatenate(spots))
        length = len(index.notices[t])
        for phrase in index.phrases[t]:
            spots = spots[near(phrase_starts(at, phrase), spots, -2 * DRIFT, length + 2 * DRIFT - len(phrase))]
        if not len(spots):
            continue
        held = np.zeros(len(spots), np.int64)
        for position, w in enumerate(index.notices[t]):
            held += near(at.get(w, np.empty(0, np.int64)), spots + position, -2 * DRIFT, 2 * DRIFT)
        share = float(held.max()) / length
        if share >= LEAST_SHARE:
            found[index.labels[t]] = max(found.get(index.labels[t], 0.0), share)
    return found


def places_of(text: bytes, index: NoticeIndex) -> tuple[int, dict[int, np.ndarray]]:
    """Number of words of a text, and the places of its license words."""
    words = terms_of(text)
    get = index.number.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    hits = np.flatnonzero(ids >= 0)
    order = hits[np.argsort(ids[hits], kind="stable")]
    known, first = np.unique(ids[order], return_index=True)
    return len(words), dict(zip(known.tolist(), np.split(order, first[1:]), strict=False))


def word_weights(docs: DataFrame, index: NoticeIndex) -> list[float]:
    """Inverse document frequency of every license word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = set(index.words)
        df = np.zeros(len(index.number) + 1, np.int64)
        for batch in pieces(batches):
            for text in bytes_of(batch):
                df[[index.number[w] for w in words.intersection(terms_of(text))]] += 1
                df[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], ["word", "df"])

    counted = documents(docs).select("text").mapInArrow(run, "word int, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    # a row a license word
    df = {r.word: r.df for r in counted.collect()}
    n = df.get(len(index.number), 0)
    return [math.log((n + 1) / (df.get(w, 0) + 1)) for w in range(len(index.number))]


def license_scan(docs: DataFrame, notices: list[tuple[str, str, tuple[str, ...]]] = NOTICES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found)`` for every row of ``docs``.

    Positional rare-token index: a file's license words of highest inverse document frequency (counted over all documents) are
    looked up among the notices' postings, which are intersected by relative position; the mandatory phrases and the
    share of a notice's words near their positions decide. ``found`` lists the notices' labels with that share. Base
    phrases count at every place where their words stand consecutively. The score is the highest share, 1 with a base phrase.

    Null texts are empty: no words, no labels, score 0. Texts of any length are read whole; every row gets a row, repeated and null ids
    too. An empty table gives an empty result; other columns are never read.
    """
    index = NoticeIndex(notices)
    idf = word_weights(docs, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in bytes_of(batch):
                n_words, at = places_of(text, index)
                places = [(phrase_starts(at, phrase), label) for phrase, label in index.base]
                starts = np.concatenate([s for s, _ in places])
                base = {label for s, label in places if len(s)}
                found = notices_found(at, index, idf)
                score = 1.0 if base else max(found.values(), default=0.0)
                first, last = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
                rows.append((n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | set(found))), score, sorted(found.items())))
            columns = list(zip(*rows, strict=True))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            pairs = pa.array([[{"label": a, "share": b} for a, b in x] for x in columns[7]], pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(columns[:7], kinds, strict=True)], pairs],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(
        run,
        f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "found array<struct<label: string, share: double>>",
    )
