"""Quality by compression: how much better a text packs with what good texts share than with what bad ones do.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is cut
into pieces of ``PIECE`` bytes, so that the dictionaries and not the text's own past decide; each
piece is packed with both. The difference of the two total sizes by their sum is the one number a
text is judged by. A logistic curve, fitted on labelled texts that the dictionaries have not seen,
turns it into the score.

Bounds: dictionaries are trained on at most ``SAMPLE`` pieces a class, drawn by a hash over all
pieces of all its training texts, and hold at most ``DICTIONARY`` bytes each; the curve is fitted
on at most about ``FITTED`` texts. Every text is scored whole.

Defined results: null and empty texts have difference 0; without labels of both classes the score
is 1 where all are good, 0 where all are bad, 0.5 without any; several labels of an id: the largest;
a class of one text is learned from and fitted on, too; repeated rows give repeated results; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import binary_list, fold_of, slices, small_or_shuffled

PIECE, SAMPLE, DICTIONARY, FITTED, LEVEL = 512, 20_000, 524_288, 20_000, 3
_SPAN = 1 << 32


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, text, good`` of labelled documents outside the fold ``held_out``."""
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.where("text is not null").select("doc_id", "text").join(small_or_shuffled(own), "doc_id")
    return rows.where(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id", "text", (F.col("quality") > 0).alias("good"))


def _place(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_SPAN))


def pieces(rows: DataFrame, share: dict[bool, float], seed: int = 0) -> DataFrame:
    """``good, h, piece``: pieces of texts whose hash falls in their class's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: tuple[list, list, list] = [], [], []
                for i, good, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary_list(part.column(2)), strict=True):
                    for a in range(0, len(text), PIECE):
                        h = xxhash.xxh3_64_intdigest(f"{i} {a}".encode(), seed) >> 1
                        if h < share[good] * (1 << 63):
                            for column, v in zip(out, (good, h, text[a : a + PIECE]), strict=True):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["good", "h", "piece"])

    return rows.select("doc_id", "good", "text").mapInArrow(run, "good boolean, h long, piece binary")


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on ``samples``; their own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 2)), samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


class Packers:
    """Both dictionaries, ready to pack."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [self._packer(good), self._packer(bad)]

    @staticmethod
    def _packer(data: bytes) -> zstandard.ZstdCompressor:
        shared = zstandard.ZstdCompressionDict(data) if data else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: bytes | None) -> float:
        """How much larger the text packs with the bad dictionary, by the sum of both sizes."""
        cut = [text[a : a + PIECE] for a in range(0, len(text), PIECE)] if text else []
        good, bad = (sum(map(len, map(p.compress, cut))) for p in self.both)
        return (bad - good) / (bad + good) if cut else 0.0


def differences(df: DataFrame, good: bytes, bad: bytes, kept: str) -> DataFrame:
    """``df`` (last column: text) with the text replaced by ``difference``."""
    shared = df.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = Packers(*shared.value)
        for batch in batches:
            for part in slices(batch):
                x = [packers.difference(t) for t in binary_list(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, pa.float64())], [*part.schema.names[:-1], "difference"])

    return df.mapInArrow(run, f"{kept}, difference double")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method; a slight ridge keeps separated classes finite."""
    scale = np.abs(x).mean() + 1e-9
    a, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 0.01 * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return float(w[0] / scale), float(w[1])


def train(labelled: DataFrame, sample: int = SAMPLE, fitted: int = FITTED) -> dict:
    """A model from ``labelled(doc_id, text, good)``. About a fifth of each class is kept back for the curve."""
    place = _place("doc_id")
    cut = F.percentile_approx(place, 0.2)
    size = F.sum(F.ceil(F.octet_length("text") / PIECE))
    seen = {r.good: r for r in labelled.groupBy("good").agg(F.count("*").alias("n"), size.alias("pieces"), cut.alias("cut"), F.max(place).alias("last")).collect()}
    if len(seen) < 2:
        return {"fit": None, "score": next((1.0 if good else 0.0 for good in seen), 0.5)}
    # where all of a class hash alike, it is both learned from and fitted on
    alone = {good: r.cut >= r["last"] for good, r in seen.items()}
    back = F.when(F.col("good"), place <= seen[True].cut).otherwise(place <= seen[False].cut)
    both = F.when(F.col("good"), F.lit(alone[True])).otherwise(F.lit(alone[False]))
    share = {good: min(1.0, 1.5 * sample / max(1, r.pieces)) for good, r in seen.items()}
    drawn = pieces(labelled.where(~back | both), share)
    samples = {good: [bytes(r.piece) for r in drawn.where(F.col("good") == good).orderBy("h", "piece").limit(sample).collect()] for good in seen}
    packed = [dictionary(samples[good]) for good in (True, False)]
    rate = min(1.0, fitted / max(1, 0.2 * sum(r.n for r in seen.values())))
    few = labelled.where(back | both).where((_place("doc_id", "good") < rate * _SPAN) | both)
    x = differences(few.select("good", "text"), *packed, "good boolean").toPandas()
    return {"fit": logistic(x["difference"].to_numpy(), x["good"].to_numpy().astype("f8")), "good": packed[0], "bad": packed[1]}


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted, difference`` of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model["fit"] is None:
        out = rows.select("doc_id", F.lit(model["score"]).alias("score"), F.lit(0.0).alias("difference"))
    else:
        slope, offset = model["fit"]
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("difference") * slope + offset))
        out = differences(rows, model["good"], model["bad"], f"doc_id {docs.schema[doc_id].dataType.simpleString()}")
        out = out.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "difference")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")
