"""SentencePiece encoding and decoding through tables of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, pieces, texts_of

MARK = "▁"
#: A table is emptied when it holds this many words; longer words are segmented where they stand.
TABLE_WORDS, WORD_CHARS = 200_000, 200
_CHUNK = re.compile(" +[^ ]*")


class WordTable:
    """Ids of distinct marked words, each as packed little-endian 32-bit integers.

    A marked word is a run of white space markers with the characters up to the next one. No piece of the vocabulary holds
    a marker after another character, so no merge crosses the front of a marked word and its ids depend on nothing else.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, bytes] = {}
        self.lone = self._packed([self.sp.piece_to_id(MARK)])
        self.begin, self.end = self._packed([self.sp.bos_id()]), self._packed([self.sp.eos_id()])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words of a text, without the first marker, which the library adds in front."""
        text = text.replace(MARK, " ")
        if text and text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        return [chunk[1:] for chunk in _CHUNK.findall(" " + text)] if text else []

    def learn(self, texts: list[list[str]]) -> dict[str, bytes]:
        """The table with every word of ``texts``; the words it lacks are segmented once each."""
        if len(self.ids) > TABLE_WORDS:
            self.ids = {}
        new = set()
        for words in texts:
            new.update(words)
        new = [w for w in new if w and w not in self.ids]
        table = self.ids
        if any(len(w) > WORD_CHARS for w in new):
            table = dict(self.ids)
        for word, ids in zip(new, self.sp.encode(new, num_threads=1) if new else [], strict=True):
            packed = self._packed(ids)
            table[word] = packed
            if table is not self.ids and len(word) <= WORD_CHARS:
                self.ids[word] = packed
        table[""] = self.lone
        return table

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        table = self.learn(split)
        return [b"".join([self.begin, *[table[w] for w in words], self.end]) for words in split]

    def decode(self, packed: bytes) -> str:
        return self.sp.decode(np.frombuffer(packed, "<u4").tolist())


def marks_lead(model: bytes) -> bool:
    """True when no piece holds the marker after another character, which the table needs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids with begin and end, packed as unsigned little-endian 32-bit integers, and their decoding.

    Each task segments every distinct marked word of its documents once and joins the ids back by position; only words
    beyond the bound of its table are segmented again. The model (its file size, under 1 MB here, is the bound) is
    read on the driver and sent with the tasks. Null texts count as empty and give the two frame ids; every row of ``docs``
    gives one row. Nothing is shuffled.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    if not marks_lead(model):
        raise ValueError("pieces of this model cross white space markers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        for batch in pieces(batches):
            ids = table.encode(texts_of(batch))
            decoded = [table.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def token_counts(encoded: DataFrame) -> DataFrame:
    """Digests of :func:`encode_decode`: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
