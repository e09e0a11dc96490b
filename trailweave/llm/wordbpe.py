"""Token counts and token ids for whole texts with a word-level BPE vocabulary file.

No merge and no pre-token of such a vocabulary crosses ASCII white space, so a text is the
sequence of its maximal runs of other bytes ("pieces" below) and the library's result for the
text is the concatenation of its results for the pieces, special strings included.

Token counts take two tiers. A first pass keeps in every task a bounded summary of frequent
pieces; the summaries (not the pieces) are merged in two levels, and the lengths of the
``FREQUENT`` most frequent pieces become a hash table that is broadcast. A second pass sums
lengths from it; what it lacks is encoded by the library in batches and kept in a bounded
cache of the worker. No piece is ever shuffled.

Nulls count as empty texts; empty texts have 0 tokens; very long texts are split like others,
and pieces over ``LONG`` bytes are encoded but not cached; repeated rows and repeated ids give
one row each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import os
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import binary_list, slices

#: Entries of the broadcast table, entries each task reports, and entries a worker caches.
FREQUENT, REPORTED, CACHED = 65_536, 16_384, 1_500_000
#: Bytes beyond which a piece is neither counted as frequent nor cached.
LONG = 64
#: Stands between pieces that the library encodes together.
SEPARATOR = "\x01"
#: Fixed value: what tokens that end a word end with.
WORD_END = "</w>"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: A capital before a byte that may begin a combining mark (U+0300 on, but for U+2000 to U+203F).
_CAPITAL_COMPOSES = re.compile(rb"[A-Z](?!\xe2\x80)[\xcc-\xff]").search
#: First bytes of U+00C0 to U+00FF, U+0140 to U+017F, U+0400 to U+047F: letters, but for two signs.
_LETTERS_AFTER, _NO_LETTERS = {b"\xc3", b"\xc5", b"\xd0", b"\xd1"}, {"×".encode(), "÷".encode()}
_TOKENIZERS: dict = {}
_ENDS: dict = {}
_TABLES: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The library's tokenizer for a vocabulary file, loaded once in a process."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].no_truncation()
        _TOKENIZERS[path].no_padding()
    return _TOKENIZERS[path]


def word_ends(path: str) -> np.ndarray:
    """By id whether a token ends a word; empty where the vocabulary has no mark for that."""
    if path not in _ENDS:
        t = tokenizer(path)
        ends = np.zeros(t.get_vocab_size(), bool)
        for token, i in t.get_vocab().items():
            ends[i] = token.endswith(WORD_END)
        _ENDS[path] = ends if ends.any() else ends[:0]
    return _ENDS[path]


def _cut(ids: np.ndarray, ends: np.ndarray, skip: int) -> list[bytes]:
    """Runs of ids that stop at each of ``ends`` (so many ids of each left out) and at the last id."""
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *(4 * ends + 4).tolist()], [*(4 * ends + 4 - 4 * skip).tolist(), len(raw)], strict=True)]


def encode_pieces(path: str, pieces: list[bytes]) -> list[bytes]:
    """For each piece the library's ids as little-endian unsigned 32-bit numbers.

    Hundreds of pieces go to the library as one text. Pieces of letters alone are one word each,
    which the vocabulary's mark for the end of a word tells apart; where there are not just as
    many words, and for other pieces, ``SEPARATOR`` sets pieces apart, whose id then cuts the
    result. Pieces that hold it, or are long, are encoded on their own.
    """
    t, out, marks = tokenizer(path), [b""] * len(pieces), word_ends(path)
    mark = t.encode(SEPARATOR, add_special_tokens=False).ids
    plain = [k for k, p in enumerate(pieces) if len(mark) == 1 and len(p) <= LONG and b"\x01" not in p]

    def encoded(own: list[int], between: bytes) -> Iterator[tuple[list[int], np.ndarray]]:
        groups = [own[k : k + 256] for k in range(0, len(own), 256)]
        texts = [between.join([pieces[k] for k in g]).decode() for g in groups]
        for g, e in zip(groups, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            yield g, np.array(e.ids, "<u4")

    if len(marks):
        words = [k for k in plain if pieces[k].isalpha() or not pieces[k].isascii() and pieces[k].decode().isalpha()]
        done: set[int] = set()
        for g, ids in encoded(words, b" "):
            ends = np.flatnonzero(marks[ids])
            if len(ends) == len(g) and ends[-1] == len(ids) - 1:
                done.update(g)
                for k, x in zip(g, _cut(ids, ends[:-1], 0), strict=True):
                    out[k] = x
        plain = [k for k in plain if k not in done]
    for g, ids in encoded(plain, f" {SEPARATOR} ".encode()):
        cuts = np.flatnonzero(ids == mark[0])
        if len(cuts) != len(g) - 1:
            raise ValueError("the separator occurs in a piece's own ids")
        for k, x in zip(g, _cut(ids, cuts, 1), strict=True):
            out[k] = x
    rest = [k for k, p in enumerate(pieces) if len(mark) != 1 or len(p) > LONG or b"\x01" in p]
    for k, e in zip(rest, t.encode_batch_fast([pieces[k].decode() for k in rest], add_special_tokens=False), strict=True):
        out[k] = np.array(e.ids, "<u4").tobytes()
    return out


def _length(ids: bytes) -> int:
    return len(ids) // 4


def _stem(piece: bytes) -> bytes:
    """A piece without closing ASCII punctuation, which has the same ids apart as together.

    ASCII letters are lower-cased, unless one stands before what may be a combining mark: there case
    and composition interact. Punctuation is cut off after ASCII letters and digits, and after Latin
    and Cyrillic letters that neither compose nor fall apart when lower-cased: what stands there can
    join no token before it. Pieces that may hold a special string stay as they are.
    """
    if b"<|" in piece:
        return piece
    if piece.isascii() or not _CAPITAL_COMPOSES(piece):
        piece = piece.lower()
    stem = piece.rstrip(_PUNCTUATION)
    if stem[-1:].isalnum() or stem[-2:-1] in _LETTERS_AFTER and stem[-2:] not in _NO_LETTERS:
        return stem
    return piece


def piece_table(key: str, path: str, value=None, fixed: dict | None = None) -> PieceTable:
    """The process's table for one application of an operator: a reused worker keeps its cache."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(path, value, fixed)
    return _TABLES[key]


class PieceTable:
    """Results by piece: ``fixed`` ones stay, others are encoded when first met.

    ``value`` makes of a piece's ids what is kept; values of parts add up. Half of ``CACHED`` entries
    fill a generation; the one before it is kept for a look, so that pieces in use are not lost.
    """

    def __init__(self, path: str, value=None, fixed: dict | None = None):
        self.path, self.value = path, value or bytes
        self.fixed = {**(fixed or {}), b"": self.value(b"")}
        self.found, self.older = dict(self.fixed), {}

    def _missing(self, pieces: set[bytes]) -> set[bytes]:
        """Those of ``pieces`` without a result, once the older generation's are taken over."""
        found, older = self.found, self.older
        new = pieces.difference(found)
        if older:
            kept = [p for p in new if p in older]
            found.update(zip(kept, map(older.__getitem__, kept), strict=True))
            new.difference_update(kept)
        return new

    def lookup(self, texts: list[list[bytes]]) -> list[list]:
        """For each list of pieces the list of their results."""
        if len(self.found) > CACHED // 2 + len(self.fixed):
            self.found, self.older = dict(self.fixed), self.found
        found = self.found
        result, new, stems = found.__getitem__, self._missing(set().union(*texts)), []
        if new:
            # most pieces are words of small ASCII letters, which are their own stems
            cut = [p for p in new if not (p.isalpha() and p.islower())]
            firsts = list(map(_stem, cut))
            ends = [p[len(a) :] for p, a in zip(cut, firsts, strict=True)]
            stems = list(self._missing(new.difference(cut).union(firsts, ends)))
            found.update(zip(stems, map(self.value, encode_pieces(self.path, stems)), strict=True))
            found.update(zip(cut, [a + b for a, b in zip(map(result, firsts), map(result, ends), strict=True)], strict=True))
        rows = [list(map(result, pieces)) for pieces in texts]
        for p in [p for p in (*stems, *new) if len(p) > LONG]:
            found.pop(p, None)
        return rows


def _merge(counts: dict[bytes, int], keep: int) -> dict[bytes, int]:
    """The ``keep`` most frequent entries, the smaller bytes first among equals."""
    if len(counts) <= keep:
        return counts
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    for batch in batches:
        for part in slices(batch):
            for text in binary_list(part.column(0)):
                for p in text.split() if text else ():
                    counts[p] = counts.get(p, 0) + 1
            if len(counts) > 16 * REPORTED:
                counts = _merge(counts, 4 * REPORTED)
    counts = _merge({p: n for p, n in counts.items() if len(p) <= LONG}, REPORTED)
    yield pa.RecordBatch.from_pydict(
        {"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "summary": [pickle.dumps(counts)]}
    )


def frequent_pieces(df: DataFrame, text: str = "text", keep: int = FREQUENT) -> list[bytes]:
    """The most frequent pieces of all texts, from the tasks' bounded summaries."""
    source = df.select(F.col(text).alias("t"))
    slots = max(1, math.isqrt(source.rdd.getNumPartitions()))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        for blob in rows["summary"]:
            for p, n in pickle.loads(blob).items():
                total[p] = total.get(p, 0) + n
        return pd.DataFrame({"summary": [pickle.dumps(_merge(total, keep))]})

    merged = (
        source.mapInArrow(_summaries, "task long, summary binary")
        .withColumn("slot", F.col("task") % slots)
        .groupBy("slot")
        .applyInPandas(merge, "summary binary")
    )
    total: dict[bytes, int] = {}
    for row in merged.toLocalIterator():
        for p, n in pickle.loads(bytes(row.summary)).items():
            total[p] = total.get(p, 0) + n
        total = _merge(total, 2 * keep)
    return list(_merge(total, keep))


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row; see the module for nulls and the rest."""
    spark = df.sparkSession
    pieces = frequent_pieces(df, text, keep)
    lengths = {p: len(ids) // 4 for p, ids in zip(pieces, encode_pieces(path, pieces), strict=True)}
    shared, key = spark.sparkContext.broadcast(lengths), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(key, path, _length, shared.value)
        for batch in batches:
            for part in slices(batch):
                texts = [x or b"" for x in binary_list(part.column(1))]
                sums = [sum(x) for x in table.lookup([x.split() for x in texts])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
