"""Language identification by nearest centroids of n-gram vectors, with rejection by distance.

A text is the TF-IDF vector of its byte 1- to 3-grams (A-Z lower-cased, other ASCII than
letters as one blank), hashed to ``BINS`` bins, with logarithmic counts, scaled to length 1.
IDF comes from all training documents. Every language has up to ``CLUSTERS`` centroids, from
spherical k-means over at most about ``SAMPLE`` training documents in all, drawn by a hash of
the id and evenly over the languages (a fit on a bounded sample: of a language with a share of
``each`` documents no more than ``2 * each`` are taken). A text gets the language of
the centroid of the largest cosine; it is rejected when it lies farther from that centroid
than ``REACH`` times the distance within which, in every language, all but a share ``ODD`` of the
sample lie of their own centroids. So a few junk or mislabelled rows do not end rejection.

Null texts and texts without a letter are ``und`` with score 0, and rejected; so is every text
if there is nothing to learn from. Ties go to the language that sorts first. Very long texts
are counted in parts. Repeated rows give repeated results; an empty table gives an empty result
(and, to learn from, no language); further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import binary_list, slices

BINS, CLUSTERS, SAMPLE, REACH, ODD = 8192, 4, 4_000, 1.2, 0.005
_FOLD = bytes(b if b >= 128 else (b | 32) if chr(b).isalpha() else 32 for b in range(256))


def counts_of(text: bytes) -> np.ndarray:
    """Counts of a text's n-grams by bin."""
    total = np.zeros(BINS, "i8")
    data = text.translate(_FOLD)
    for a in range(0, max(1, len(data)), 1 << 20):
        b = np.frombuffer(b" " + data[max(0, a - 2) : a + (1 << 20)] + b" ", "u1").astype("u4")
        code = b[2:] if a else b[1:]
        for n in (1, 2, 3):
            if n > 1:
                shift = b[: len(b) - n + 1].copy()
                for j in range(1, n):
                    shift = (shift << np.uint32(8)) | b[j : len(b) - n + 1 + j]
                code = shift
            total += np.bincount(((code + np.uint32(n << 28)) * np.uint32(2654435761)) >> np.uint32(19), minlength=BINS)
    return total


def vectors(texts: list[bytes | None], idf: np.ndarray | None) -> np.ndarray:
    out = np.stack([counts_of(t or b"") for t in texts]).astype("f4")
    out = np.log1p(out)
    if idf is not None:
        out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids, and the cosine of each row to its own."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(12):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (x @ c.T).max(axis=1)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> dict:
    """Centroids from the labelled rows of ``df``: ``idf, langs, centres, limit``."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")).where(
        "text is not null and lang is not null"
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return {"langs": [], "idf": None, "centres": np.zeros((0, BINS), "f4"), "limit": 0.0}
    each = max(8, sample // len(sizes))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, n = np.zeros(BINS, "i8"), 0
        for batch in batches:
            for part in slices(batch):
                for t in binary_list(part.column(0)):
                    df_ += counts_of(t) > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"bin": pa.array(range(-1, BINS), pa.int32()), "n": pa.array([n, *df_.tolist()], pa.int64())})

    summed = rows.select("text").mapInArrow(seen, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    total = dict(map(tuple, summed))  # BINS + 1 rows
    idf = np.log((total[-1] + 1) / (np.array([total[k] for k in range(BINS)]) + 1)).astype("f4") + np.float32(0.05)
    share: Column = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, each / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                v = vectors(binary_list(part.column(1)), idf).astype("f2")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "v"])

    by: dict[str, list] = {}
    for r in chosen.select("lang", "text").mapInArrow(sparse, "lang string, v binary").toLocalIterator():
        if len(by.setdefault(r.lang, [])) < 2 * each:
            by[r.lang].append(np.frombuffer(bytes(r.v), "f2"))
    langs, centres, limits = [], [], []
    for name in sorted(by):
        c, own = _clusters(np.stack(by[name]).astype("f4"), CLUSTERS)
        langs += [name] * len(c)
        centres.append(c)
        limits.append(float(np.quantile(own, ODD, method="lower")))
    return {"langs": langs, "idf": idf, "centres": np.concatenate(centres).astype("f4"), "limit": 1 - REACH * (1 - min(limits))}


def predict(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected``, in the place of columns of these names."""
    df = df.drop("lang_pred", "score", "rejected")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                column = part.column(part.schema.get_field_index(text))
                known = np.array([bool(m["langs"]) and has_letter(t) for t in column.to_pylist()], bool)
                names, score, out = ["und"] * len(known), np.zeros(len(known)), np.ones(len(known), bool)
                if known.any():
                    raw = binary_list(column)
                    at = np.flatnonzero(known)
                    cosine = vectors([raw[k] for k in at], m["idf"]) @ m["centres"].T
                    best = np.argmax(cosine, axis=1)
                    value = cosine[np.arange(len(at)), best]
                    score[at] = value.clip(0, 1)
                    out[at] = value < m["limit"]
                    for k, j in zip(at.tolist(), best.tolist(), strict=True):
                        names[k] = m["langs"][j]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(out)],
                    [*part.schema.names, "lang_pred", "score", "rejected"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
