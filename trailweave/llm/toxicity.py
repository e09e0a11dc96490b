"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class, toxic and ordinary, has a model of the bytes of words up to order ``ORDER``. An
n-gram's class probability is its discounted class count over its context's, and the mass so
freed goes to a lower order that both classes share: Kneser-Ney continuation counts of the
pooled corpus. Rare expressions thus fall back on counts that favour neither class. A context
that one class has never seen leaves the decision to a shorter one. Counts are over all
labelled training documents, each word once a document.

A word's log-likelihood ratio needs its letters alone, so workers keep it in a cache. A text
is judged by its most toxic run of ``RUN`` words or fewer than that in all: the difference of
the run's log-likelihoods under the toxic and the ordinary model, by the square root of its
length in letters (of runs that tie any; their value is the same). A logistic curve turns this
one number into the score. It is fitted on at most about ``SAMPLE`` training documents (a
bounded sample) that the model used for the fit has not counted (but where a class has a single
document).

All n-grams count at every size. A table of at most ``TABLE`` of them is broadcast. A larger one is
dealt to blocks by the two letters before an n-gram's last, which all that a letter falls back on
share: tasks turn blocks into ratios, as files of the scratch folder, and scoring tasks look the
new words of many documents up block by block. Null and empty texts have no words: they score
like a text of ratio 0. Without labels of both classes, an empty table of labels among them,
every score is 0. Repeated rows give repeated results; very long texts and words are scored
whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import discard, fold_of, materialize, open_fs, released, scratch_path, slices, small_or_shuffled

ORDER, DISCOUNT, RUN, SAMPLE, TABLE = 6, 0.75, 8, 20_000, 4_000_000
#: Bytes of words that are taken apart at a time, about, and words that a worker counts or keeps at a time.
PART, WORDS = 1 << 20, 200_000
_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_CACHES: dict = {}


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACE).split() if text else []


def _parts(words: list[bytes]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """The words, each between blanks, in lists of about ``PART`` bytes: number of the word, place,
    bytes of the part before that only begin n-grams, bytes. Long words go in parts that overlap."""
    out, size = [], 0
    for number, w in enumerate(words):
        for a in range(0, len(w) + 2, PART):
            start = max(0, a - ORDER + 1)
            if len(w) + 2 <= PART:
                piece = b" " + w + b" "
            else:
                piece = b" " * (start == 0) + w[max(0, start - 1) : a + PART - 1] + b" " * (a + PART > len(w) + 1)
            out.append((number, start, a - start, piece))
            size += len(piece)
            if size >= PART:
                yield out
                out, size = [], 0
    if out:
        yield out


def _letters(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all parts: bytes, place in the word (-1 where a byte is another part's own), the word's number, first places."""
    joined = np.frombuffer(b"".join(p[3] for p in parts), "u1").astype("u8")
    sizes = np.array([len(p[3]) for p in parts], "i8")
    first = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    numbers, starts, skips = np.array([p[:3] for p in parts], "i8").T
    place = np.arange(len(joined)) - first[part]
    place = np.where(place < skips[part], -1, place + starts[part])
    return joined, place, numbers[part], first


def _keys(letters: np.ndarray, order: int) -> np.ndarray:
    """Of each place the ``order`` bytes that end there, as a number (wrong where a word begins later)."""
    key = letters.copy()
    for j in range(1, order):
        key[j:] |= letters[:-j] << np.uint64(8 * j)
    return key


def _grams(words: list[bytes], weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for parts in _parts(words):
        letters, place, number, _ = _letters(parts)
        for order in range(1, ORDER + 1):
            use = place >= max(1, order - 1)
            keys, inverse = np.unique(_keys(letters, order)[use], return_inverse=True)
            sums = np.stack([np.bincount(inverse, weights=weights[number[use], j], minlength=len(keys)) for j in range(weights.shape[1])])
            yield order, keys, sums.astype("i8")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``n, key`` and counts ``c0..c3`` (ordinary, toxic, and the same of the fold kept back) of ``labelled(text, class)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CACHES.clear()
        counts: dict[bytes, int] = {}  # four counts a word, in 32 bits each
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                weights = np.array([[counts[w] >> 32 * j & 0xFFFFFFFF for j in range(4)] for w in part], "f8")
                for order, keys, sums in _grams(part, weights):
                    yield pa.RecordBatch.from_pydict(
                        {"n": pa.array(np.full(len(keys), order, "i4")), "key": pa.array(keys.view("i8"))}
                        | {f"c{j}": pa.array(sums[j]) for j in range(4)}
                    )
            counts.clear()

        for batch in batches:
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(words_of(text)):
                    n = counts.get(w)
                    if n is None:
                        n, size = 0, size + len(w)
                    counts[w] = n + (1 << 32 * kind)
                if len(counts) > WORDS or size > 16 << 20:
                    yield from flush()
                    size = 0
        if counts:
            yield from flush()
        released()

    return (
        labelled.select("text", "class")
        .mapInArrow(run, "n int, key long, c0 long, c1 long, c2 long, c3 long")
        .groupBy("n", "key")
        .agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(4)])
    )


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), "i8"), np.zeros(len(keys), bool)
    k = np.searchsorted(table, keys).clip(0, len(table) - 1)
    return k, table[k] == keys


def ratios(grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], pairs: np.ndarray | None = None) -> dict[int, tuple]:
    """For each order: keys and log ratios, contexts and the log ratios of their freed mass.

    ``grams``: by order the sorted keys and their counts, ordinary and toxic. ``pairs``: in how many
    n-grams of order 3 those of order 2 end, where ``grams`` holds a block of that order only.
    """
    shared: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out: dict[int, tuple] = {}
    own: dict[int, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        keys, ordinary, toxic = grams[n]
        mask = np.uint64((1 << 8 * (n - 1)) - 1)
        context = keys >> np.uint64(8)
        heads, head = np.unique(context, return_inverse=True)
        if n == 2 and pairs is not None:
            spread = pairs
        elif n < ORDER:
            longer = np.sort(grams[n + 1][0] & np.uint64((1 << 8 * n) - 1))
            spread = np.searchsorted(longer, keys, "right") - np.searchsorted(longer, keys, "left")
        else:
            spread = ordinary + toxic
        spread = np.maximum(spread, 1).astype("f8")
        if n == 1:
            low = np.full(len(keys), 1 / 256)
            own_low = {c: low for c in (0, 1)}
        else:
            k, there = _at(shared[n - 1][0], keys & mask)
            low = np.where(there, shared[n - 1][1][k], 1e-6)
            own_low = {c: np.where(there, own[c][k], low) for c in (0, 1)}
        sums, kinds = np.bincount(head, spread), np.bincount(head)
        shared[n] = keys, (spread - DISCOUNT + DISCOUNT * kinds[head] * low) / sums[head]
        p, freed, now = [], [], {}
        for c, count in ((0, ordinary), (1, toxic)):
            total, seen = np.bincount(head, count), np.bincount(head, count > 0)
            g = np.where(total > 0, DISCOUNT * seen / np.maximum(total, 1), 1.0)
            value = np.where(
                total[head] > 0,
                (np.maximum(count - DISCOUNT, 0) + DISCOUNT * seen[head] * low) / np.maximum(total[head], 1),
                own_low[c],
            )
            now[c] = np.maximum(value, 1e-12)
            p.append(np.log(now[c]))
            freed.append(np.where(total > 0, np.log(np.maximum(g, 1e-12)), np.nan))
        own = now
        ratio = freed[1] - freed[0]
        both = ~np.isnan(ratio)
        out[n] = keys, (p[1] - p[0]).astype("f4"), heads[both], ratio[both].astype("f4")
    return out


def block_of(pair, blocks: int):
    """The block of a context's last two letters, as column or array."""
    return pair * 40_503 % 65_521 % blocks


class Blocks:
    """A table too large to broadcast: its two low orders, and files of blocks of the others."""

    def __init__(self, base: str, low: dict[int, tuple], there: set[int], blocks: int):
        self.base, self.low, self.there, self.blocks = base, low, there, blocks

    def parts(self, keys: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, dict[int, tuple]]]:
        """Places and the table that holds all of them."""
        fs, base = open_fs(self.base)
        block = np.where(place >= 2, block_of(((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype("i8"), self.blocks), -1)
        order = np.argsort(block, kind="stable")
        found, start = np.unique(block[order], return_index=True)
        for k, use in zip(found.tolist(), np.split(order, start[1:]), strict=True):
            table = self.low
            if k in self.there:
                with fs.open_input_stream(f"{base}/{k}") as f:
                    table = self.low | pickle.loads(zstandard.decompress(f.read()))
            yield use, table


def word_ratios(words: list[bytes], table: dict[int, tuple] | Blocks) -> np.ndarray:
    """Log-likelihood ratio of each word, toxic over ordinary, by its length in bytes and one blank."""
    if not words:
        return np.zeros(0)
    out = np.zeros(len(words))
    for parts in _parts(words):
        letters, place, number, first = _letters(parts)
        total, open_, all_keys = np.zeros(len(letters)), place >= 1, _keys(letters, ORDER)
        for at, part in table.parts(all_keys, place) if isinstance(table, Blocks) else [(np.arange(len(letters)), table)]:
            at = at[open_[at]]
            for n in range(ORDER, 0, -1):
                keys, ratio, heads, freed = part[n]
                use = at[place[at] >= n - 1]
                key = all_keys[use] & np.uint64((1 << 8 * n) - 1)
                k, there = _at(keys, key)
                total[use[there]] += ratio[k[there]] if len(ratio) else 0
                open_[use[there]] = False
                use, key = use[~there], key[~there]
                k, there = _at(heads, key >> np.uint64(8))
                total[use[there]] += freed[k[there]] if len(freed) else 0
                open_[use[there]] = False
                at = at[open_[at]]
        np.add.at(out, number[first], np.add.reduceat(total, first))
    return out / np.sqrt(np.array([len(w) for w in words]) + 1.0)


def described(texts: list[str | None], table: dict[int, tuple] | Blocks, cache: dict[bytes, float]) -> np.ndarray:
    """Of each text the largest log-likelihood ratio of a run of words, by the root of its letters."""
    words = [words_of(t) for t in texts]
    new = [w for w in set().union(*words) if w not in cache]
    if len(cache) > WORDS:
        cache.clear()
        new = list(set().union(*words))
    step = 200_000 if isinstance(table, Blocks) else 20_000
    for a in range(0, len(new), step):
        part = new[a : a + step]
        cache.update(zip(part, word_ratios(part, table).tolist(), strict=True))
    long = [w for w in new if len(w) > 200]
    out = np.zeros(len(texts))
    for k, ws in enumerate(words):
        if ws:
            letters = np.array(list(map(len, ws))) + 1.0
            ratio = np.array(list(map(cache.__getitem__, ws))) * np.sqrt(letters)
            n = min(RUN, len(ws))
            upto, sizes = np.concatenate([[0.0], np.cumsum(ratio)]), np.concatenate([[0.0], np.cumsum(letters)])
            out[k] = ((upto[n:] - upto[:-n]) / np.sqrt(sizes[n:] - sizes[:-n])).max()
    for w in long:
        del cache[w]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve, by Newton's method on the scaled numbers."""
    mean, scale = x.mean(), x.std() + 1e-6
    a = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2)
        w -= np.linalg.solve(h, a.T @ (p - y) + 0.5 * w)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def _by_order(rows: pa.Table, back: bool) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order the keys, sorted, and their counts, with those of the fold kept back or without."""
    n, key = rows["n"].to_numpy(), rows["key"].to_numpy().view("u8")
    c = [rows[f"c{j}"].to_numpy() for j in range(4)]
    ordinary, toxic = (c[0] + c[2], c[1] + c[3]) if back else (c[0], c[1])
    by = {}
    for k in range(1, ORDER + 1):
        at = np.flatnonzero((n == k) & (ordinary + toxic > 0))
        at = at[np.argsort(key[at])]
        by[k] = key[at], ordinary[at], toxic[at]
    return by


def _tables(grams: DataFrame) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """The tables of the folds but the one kept back, and of all."""
    rows = grams.toArrow()
    return ratios(_by_order(rows, False)), ratios(_by_order(rows, True))


def _blocks(grams: DataFrame, limit: int) -> tuple[Blocks, Blocks]:
    """The same, as blocks of about a quarter of ``limit`` n-grams; the driver holds two orders only."""
    spark, blocks = grams.sparkSession, -(-4 * grams.count() // max(1, limit))
    low = grams.where("n < 3").toArrow()
    seen = (F.col("c0") + F.col("c1") > 0).cast("long")
    ends = grams.where("n = 3").groupBy(F.expr("key & 65535L").alias("pair")).agg(F.sum(seen).alias("p0"), F.count("*").alias("p1")).orderBy("pair").toArrow()
    bases = [scratch_path(spark, "ratios") for _ in range(2)]

    def pairs(k: int, keys: np.ndarray) -> np.ndarray:
        at, there = _at(ends["pair"].to_numpy().astype("u8"), keys)
        return np.where(there, ends[f"p{k}"].to_numpy()[at], 0) if len(ends) else np.zeros(len(keys), "i8")

    of_low = [_by_order(low, bool(k)) for k in range(2)]
    of_pairs = [pairs(k, of_low[k][2][0]) for k in range(2)]
    shared = spark.sparkContext.broadcast([({n: by[n] for n in (1, 2)}, of) for by, of in zip(of_low, of_pairs, strict=True)])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        for base, back, (by, of) in zip(bases, (False, True), shared.value, strict=True):
            fs, at = open_fs(base)
            fs.create_dir(at, recursive=True)
            found = ratios(_by_order(table, back) | by, of)
            with fs.open_output_stream(f"{at}/{key[0].as_py()}") as f:
                f.write(zstandard.compress(pickle.dumps({n: found[n] for n in range(3, ORDER + 1)})))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    dealt = grams.where("n >= 3").withColumn("block", block_of(F.expr("shiftrightunsigned(key, 8) & 65535L"), blocks).cast("int"))
    there = {r.block for r in dealt.groupBy("block").applyInArrow(write, "block int").collect()}
    return tuple(Blocks(base, ratios(by, of), there, blocks) for base, by, of in zip(bases, of_low, of_pairs, strict=True))


def train(labelled: DataFrame, limit: int = TABLE, sample: int = SAMPLE) -> dict:
    """A model from ``labelled(doc_id, text, toxic, back)``; ``back`` marks the fold the fit is made on.

    A class that this fold or the others lack is split anew, about a fifth of its documents kept
    back; one of a single document counts and is fitted on, too."""
    rows = labelled.where("text is not null and toxic is not null")
    toxic = (F.col("toxic") > 0).cast("int")
    of_class = toxic + F.when(F.col("back"), 2).otherwise(0)
    sizes = {r["class"]: r["count"] for r in rows.groupBy(of_class.alias("class")).count().collect()}
    if not all(sizes.get(c, 0) + sizes.get(c + 2, 0) for c in (0, 1)):
        return {"table": None, "fit": None}
    alone, back = [], F.col("back")
    for c in (0, 1):
        if not (sizes.get(c) and sizes.get(c + 2)):
            place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))  # percentiles are doubles
            near = rows.where(toxic == c).agg(F.percentile_approx(place, 0.2).alias("fifth"), F.max(place).alias("last")).first()
            if near.fifth < near.last:
                back = F.when(toxic == c, place <= near.fifth).otherwise(back)
            else:
                alone.append(c)
                back = F.when(toxic == c, False).otherwise(back)
    rows = rows.withColumn("class", (toxic + F.when(back, 2).otherwise(0)).cast("int"))
    anew = [c for c in (0, 1) if not (sizes.get(c) and sizes.get(c + 2))]
    if anew:
        sizes = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    grams = materialize(gram_counts(rows), "grams")
    part, whole = _tables(grams) if grams.count() <= limit else _blocks(grams, limit)
    discard(grams)
    fitted = [2, 3, *alone]
    share = min(1.0, sample / max(1, sum(sizes.get(c, 0) for c in fitted)))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000
    few = [c for c in fitted if c % 2 in anew and sizes.get(c, 0) <= sample]
    back = rows.where(F.col("class").isin(fitted)).where(drawn | F.col("class").isin(few) if few else drawn)
    seen = _described(back.select(F.col("class").alias("y"), "text"), part, "y int").toPandas()
    return {"table": whole, "fit": _logistic(seen["ratio"].to_numpy(), (seen["y"].to_numpy() % 2 == 1).astype("f8"))}


def _described(df: DataFrame, table: dict | Blocks, kept: str) -> DataFrame:
    """``df`` (last column: text) with the text replaced by its ``ratio``."""
    shared, key = df.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(key)
        for batch in batches:
            for part in slices(batch, 10_000, 64 << 20) if isinstance(shared.value, Blocks) else slices(batch):
                x = described(part.column(part.num_columns - 1).to_pylist(), shared.value, cache)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x)], [*part.schema.names[:-1], "ratio"])
        released()

    return df.mapInArrow(run, f"{kept}, ratio double")


def cache_of(key: str) -> dict[bytes, float]:
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = {}
    return _CACHES[key]


def predict(df: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each row."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = df.schema[doc_id].dataType.simpleString()
    if model["fit"] is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    slope, offset = model["fit"]
    z = F.col("ratio") * slope + offset
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = _described(rows, model["table"], f"doc_id {kind}").select("doc_id", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labelled rows of the folds but 0 (labels go to the texts while they are few), with fold ``folds - 1`` marked ``back``; several labels of an id: the largest."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(small_or_shuffled(own), "doc_id")
    fold = fold_of(F.col("doc_id"), folds)
    return rows.where(fold != 0).withColumn("back", fold == folds - 1)
