"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

Each task gathers the distinct marked words of some texts, sorts them into an implicit trie and
walks it depth-first (``lattice.best``), so a prefix is scored once however many words share it.
The vocabulary (a fixed public one of bounded size) is broadcast; texts are never shuffled, and
a lost task depends on its own input split alone.

The encoding is lossless: every blank (U+0020) marks the word after it, characters without a
piece are spelt as UTF-8 byte pieces, and a mark in the text itself is spelt as bytes.

Defined cases: a null text has null ids and a null decoded text; an empty text has no ids; texts
of any length are encoded whole; ids outside the vocabulary decode to nothing; repeated rows are
encoded alike; an empty table gives an empty result; extra columns are not read by ``judge`` and are
kept by ``encode`` and ``decode``, where a column with the name of a new one is replaced by it.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C
from valuegrain.llm import lattice as L


def packed(words: list[str], voc: L.Vocabulary) -> dict[str, bytes]:
    return {w: array("i", ids).tobytes() for w, ids in L.best(words, voc).items()}


def encode_texts(texts: list[str | None], memory: L.Remembered) -> list[np.ndarray | None]:
    """Ids of each text. A line feed, which no piece holds, begins a word of its own, unmarked."""
    out: list[np.ndarray | None] = []
    for a, b in L.chunks(texts):
        words = [None if t is None else [] if not t else (L.MARK + t.replace(L.MARK, L.OWN_MARK).replace(" ", " " + L.MARK).replace("\n", " \n")).split(" ") for t in texts[a:b]]
        known = memory.of({w for own in words if own for w in own})
        out += [None if own is None else np.frombuffer(b"".join([known[w] for w in own]), np.int32) for own in words]
    return out


class Decoder:
    """Ids back to text: pieces by a table, runs of byte pieces as UTF-8."""

    def __init__(self, voc: L.Vocabulary):
        self.table: list[bytes] = [b""] * voc.size
        for p, i in voc.ids.items():
            self.table[i] = p.replace(L.MARK, " ").encode()
        for b, i in enumerate(voc.byte_ids):
            self.table[i] = bytes([b])

    def text(self, ids) -> str | None:
        if ids is None:
            return None
        table = self.table
        return b"".join([table[i] for i in ids if 0 <= i < len(table)])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, text_col: str = "text", model: str = L.MODEL, ids_col: str = "ids", check: bool = False) -> DataFrame:
    """All columns plus the ids; with ``check`` also the length and digest of the decoded text."""
    voc = docs.sparkSession.sparkContext.broadcast(L.load(model))
    fields = [(ids_col, T.ArrayType(T.IntegerType()))] + ([("decoded_chars", T.LongType()), ("decoded_sha256", T.StringType())] if check else [])

    def make():
        memory = L.remembered(lambda parts: packed(parts, voc.value), b"".join, voc.value.pairs)
        decoder = Decoder(voc.value)

        def work(texts):
            found = encode_texts(texts, memory)
            flat = np.concatenate([x for x in found if x is not None]) if any(x is not None for x in found) else np.zeros(0, np.int32)
            ends = np.cumsum([0 if x is None else len(x) for x in found])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([x is None for x in found] + [False]))
            out = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
            if check:
                back = [None if x is None else decoder.text(x.tolist()) for x in found]
                out += [[None if t is None else len(t) for t in back], [None if t is None else hashlib.sha256(C.utf8(t)).hexdigest() for t in back]]
            return out

        return work

    out = C.map_texts(docs, text_col, fields, make)
    return out.select(*C.carried_but(out, *[n for n, _ in fields]), *[n for n, _ in fields])


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = L.MODEL, text_col: str = "decoded") -> DataFrame:
    """All columns plus the text that the ids spell."""
    voc = encoded.sparkSession.sparkContext.broadcast(L.load(model))

    def make():
        decoder = Decoder(voc.value)
        return lambda lists: [[decoder.text(x) for x in lists]]

    out = C.map_texts(encoded, ids_col, [(text_col, T.StringType())], make)
    return out.select(*C.carried_but(out, text_col), text_col)


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text", model: str = L.MODEL) -> DataFrame:
    """(key, n_pieces, ids, decoded_chars, decoded_sha256, round_trip)."""
    done = encode(docs.select(F.col(key).alias("_key"), F.col(text_col).alias("_own")), "_own", model, check=True)
    return done.select(
        F.col("_key").alias(key), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "decoded_chars", "decoded_sha256",
        (F.sha2(F.col("_own"), 256).eqNullSafe(F.col("decoded_sha256"))).alias("round_trip"),
    )
