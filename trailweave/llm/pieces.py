"""SentencePiece encoding and decoding of whole texts as relations.

Encoding. A text, its blanks written as the model's blank mark and one put before it, is cut
where no piece of the model can reach across: before runs of blank marks, and between
characters that are neighbours in no piece. The parts, called units here, encode
independently of each other, so every distinct unit of the corpus is encoded once:

1. The reading tasks number the distinct units of each chunk of documents. They leave the
   numbers of every document in a file of the scratch folder and hand on, for each chunk, its
   units by bucket of their hash, every bucket one compressed cell.
2. Cells of a bucket meet and give the bucket's distinct units. The units' substrings, as long as
   the longest piece, are exploded and equi-joined to the piece table (broadcast; its size is
   the vocabulary's). The matches of a unit, its lattice, are grouped by unit and folded with
   Spark's higher-order ``aggregate``.
3. Ids meet the cells of their bucket again, which carry them, as compressed, back to the
   chunks; a task takes a chunk, opens its file and writes documents.

The fold. For a unigram model it is Viterbi's: the best score up to each place. A BPE model's
scores are merge ranks, and the path of the largest sum is not the library's result, so for
one the fold replays the merges on the same lattice: of all edges that span exactly two
current symbols it takes the one of the best rank, the leftmost among equals, until none is
left. Characters outside the model become their UTF-8 bytes' ids. Units over ``LONG``
characters, whose lattice would not fit the fold's bit masks, take the same merges with a heap, or
Viterbi's path in a loop.

Chunks are dealt to sets of about ``SPREAD``, and buckets are those of a set, so no group grows with
the corpus: a unit that every chunk has is encoded once in a set. Null texts count as empty and have no ids; empty texts decode to empty ones;
repeated rows and ids give a row each; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import materialize, open_fs, released, scratch_path, slices

BLANK = "▁"
LONG = 60
#: Bytes of text in a chunk, about, and the sum of its slices' distinct words after which it ends.
CHUNK, UNITS = 12 << 20, 500_000
#: Chunks in a set, about, and buckets of a set.
SPREAD, BUCKETS = 1_024, 128
#: Units, with repetitions, in a partition of the lattice, about.
PART_UNITS = 100_000
_MODELS: dict = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The tables of a model file: ids and ranks of pieces, bytes of ids, pairs inside pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.first_byte, self.unknown = {}, {}, [], None, sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                if piece == "<0x00>":
                    self.first_byte = i
            elif sp.is_control(i):
                self.bytes.append(b"")
            elif sp.is_unknown(i):
                self.bytes.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
                self.bytes.append(piece.replace(BLANK, " ").encode())
        order = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in self.scores.items()}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.pair_codes = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in self.pairs) or [-1], "i8")
        self.table = pa.array(self.bytes, pa.large_binary())

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Words, a blank mark put before each, cut between neighbours that no piece has; units of each."""
        whole = BLANK + BLANK.join(words)
        lengths = np.fromiter(map(len, words), "i8", len(words)) + 1
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.pair_codes, pairs), len(self.pair_codes) - 1)
        cut = np.concatenate([[True], self.pair_codes[at] != pairs])
        starts = np.cumsum(lengths) - lengths
        cut[starts] = True
        places = np.flatnonzero(cut).tolist()
        return [whole[a:b] for a, b in zip(places, [*places[1:], len(whole)], strict=True)], np.add.reduceat(cut, starts, dtype="u4")

    def of_char(self, c: str) -> list[int]:
        if c in self.ids:
            return [self.ids[c]]
        return [self.unknown] if self.first_byte is None else [self.first_byte + b for b in c.encode()]

    def merged(self, unit: str) -> list[int]:
        """BPE of a unit with a heap of neighbouring pairs."""
        n = len(unit)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = ends[a]
            if 0 <= a and b < n and (rank := self.ranks.get(unit[a : ends[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, ends[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not alive[a] or ends[a] != b or not alive[b] or ends[b] != e:
                continue
            alive[b] = False
            ends[a] = e
            if e < n:
                before[e] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            piece = unit[a : ends[a]]
            out += [self.ids[piece]] if piece in self.ids else self.of_char(piece)
            a = ends[a]
        return out

    def best(self, unit: str) -> list[int]:
        """Viterbi's segmentation of a unit; characters outside the model cost 10 more than its worst piece."""
        n, worst = len(unit), min(self.scores.values()) - 10
        sums, before = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                score = self.scores.get(unit[a:b], worst if b == a + 1 else None)
                if score is not None and sums[a] + score > sums[b]:
                    sums[b], before[b] = sums[a] + score, a
        cuts = [n]
        while cuts[-1]:
            cuts.append(before[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in ([self.ids[unit[a:b]]] if unit[a:b] in self.ids else self.of_char(unit[a:b]))]

    def texts(self, ids: pa.ListArray) -> list[bytes | None]:
        """Decoding: the pieces' bytes, blanks for blank marks, less the blank put in front.

        The texts as UTF-8; bytes that are none become the replacement mark.
        """
        flat = self.table.take(ids.flatten())
        _, places, data = flat.buffers()
        places = np.frombuffer(places, "i8")[flat.offset : flat.offset + len(flat) + 1]
        sizes = ids.value_lengths().fill_null(0).to_numpy()
        ends = places[np.cumsum(sizes)].tolist() if len(ids) else []
        raw, out = memoryview(data or b""), []
        for a, b, there in zip([places[0], *ends], ends, ids.is_valid().to_pylist()):
            whole = bytes(raw[a:b]).decode("utf-8", "replace").encode()
            out.append((whole[1:] if whole[:1] == b" " else whole) if there else None)
        return out


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _words(text: pa.Array) -> pa.ListArray:
    """For each text its segments, runs of blank marks with what follows, less their first blank mark.

    Most texts are split at blanks in one go; those with runs of blanks, or blank marks of their
    own, are matched one by one.
    """
    text = text.cast(pa.string()).fill_null("")
    odd = pc.or_(pc.or_(pc.equal(text, ""), pc.starts_with(text, " ")), pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, BLANK)))
    words = pc.split_pattern(text.filter(pc.invert(odd)), " ")
    rows = [[x[1:] for x in _SEGMENT.findall(BLANK + t.replace(" ", BLANK))] if t else [] for t in text.filter(odd).to_pylist()]
    if not rows:
        return words
    mask = odd.to_numpy(zero_copy_only=False)
    order = np.where(mask, len(words) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
    return pa.concat_arrays([words, pa.array(rows, words.type)]).take(pa.array(order))


def _packed_units(units: list[str]) -> bytes:
    """A unit has blank marks for blanks, so a blank can stand between units."""
    return zstandard.compress(" ".join(units).encode(), 9)


def _unpacked_units(data: bytes) -> list[str]:
    whole = zstandard.decompress(data).decode()
    return whole.split(" ") if whole else []


def _packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, compressed: of small numbers all but the first are mostly zeros."""
    return zstandard.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 3)


def _unpacked_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1).T.copy().view("<u4").ravel()


def _numbered(path: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out)
        fs.create_dir(base, recursive=True)
        model = pieces(path)
        ids, lengths, words, size, met = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = uuid.uuid4().int >> 65
            numbers = pa.chunked_array(words, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().combine_chunks()
            if isinstance(numbers, pa.ChunkedArray):
                numbers = pa.concat_arrays(numbers.chunks)
            # the most frequent word is number 0, so that most numbers are small
            segments = numbers.indices.to_numpy()
            frequent = np.argsort(-np.bincount(segments, minlength=len(numbers.dictionary)), kind="stable")
            rank = np.empty(len(frequent), "u4")
            rank[frequent] = np.arange(len(frequent))
            segments, dictionary = rank[segments], numbers.dictionary.take(pa.array(frequent))
            numbers, blocks, sizes = None, [], [np.empty(0, "u4")]
            for k in range(0, len(dictionary), 16_384):
                parts, counts = model.units(dictionary[k : k + 16_384].to_numpy(zero_copy_only=False).tolist())
                blocks.append(pa.array(parts, pa.string()))
                sizes.append(counts)
            parts, units = None, pa.concat_arrays([pa.array([], pa.string()), *blocks]).dictionary_encode()
            found = units.dictionary.to_numpy(zero_copy_only=False).tolist()
            buckets = np.fromiter((zlib.crc32(u.encode()) % BUCKETS for u in found), "i4", len(found))
            # units of a cell in order: neighbours that begin alike compress well
            order = pc.sort_indices(pa.table({"b": buckets, "u": units.dictionary}), [("b", "ascending"), ("u", "ascending")]).to_numpy()
            place = np.empty(len(order), "u4")
            place[order] = np.arange(len(order))
            payload = {
                "ids": ids,
                "lengths": _packed_numbers(np.concatenate(lengths)),
                "segments": _packed_numbers(segments),
                "sizes": _packed_numbers(np.concatenate(sizes)),
                "units": _packed_numbers(place[units.indices.to_numpy()]),
                "distinct": len(order),
            }
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(zstandard.compress(pickle.dumps(payload, protocol=5), 1))
            used, counts = np.unique(buckets, return_counts=True) if found else (np.zeros(1, "i4"), np.zeros(1, "i8"))
            ends = np.cumsum(counts)
            cells = [[found[i] for i in order[e - n : e].tolist()] for e, n in zip(ends, counts, strict=True)]
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([name] * len(cells), pa.int64()),
                    "bucket": pa.array(used, pa.int32()),
                    "n": pa.array(counts, pa.int32()),
                    "units": pa.array(list(map(_packed_units, cells)), pa.binary()),
                }
            )

        for batch in batches:
            for part in slices(batch):
                rows = _words(part.column(1))
                ids += part.column(0).to_pylist()
                lengths.append(rows.value_lengths().to_numpy())
                words.append(rows.flatten().dictionary_encode())
                size += part.column(1).nbytes
                met += len(words[-1].dictionary)
                if size > CHUNK or met > UNITS:
                    yield close()
                    ids, lengths, words, size, met = [], [], [], 0, 0
                    pa.default_memory_pool().release_unused()
        if ids:
            yield close()
        ids, lengths, words = [], [], []
        released()

    return run


# SQL: first and last place of a match, from its number.
_START, _END = "CAST(shiftright(x, 23) & 63 AS INT)", "CAST(shiftright(x, 17) & 63 AS INT)"


def bpe_fold(edges: str, n: str) -> str:
    """SQL: the cuts left (a bit mask of places 0..n) after replaying merges on a lattice.

    ``edges``: array of (k: rank and place, m: mask of the places inside, b: mask of both ends).
    """
    usable = "(st.cuts & x.b) = x.b AND bit_count(st.cuts & x.m) = 1"
    left = "(c & x.b) = x.b AND bit_count(c & x.m) > 0"
    step = f"""
        if(size(st.live) = 0, st,
           element_at(transform(array(array_min(filter(st.live, x -> {usable}))), best ->
             if(best IS NULL, named_struct('cuts', st.cuts, 'live', slice(st.live, 1, 0)),
                element_at(transform(array(st.cuts & ~best.m), c ->
                  named_struct('cuts', c, 'live', filter(st.live, x -> {left}))), 1))), 1))"""
    return f"aggregate(sequence(1, {n}), named_struct('cuts', shiftleft(1L, {n} + 1) - 1L, 'live', {edges}), (st, i) -> {step}, st -> st.cuts)"


def viterbi_fold(edges: str, n: str) -> str:
    """SQL: the cuts of the path of the largest sum of scores; ``edges``: (e, s, score), sorted by e.

    The state holds for each place the best sum so far and the place before it; a character
    that no piece covers costs ``-1e4``.
    """
    start = f"named_struct('sum', transform(sequence(0, {n}), p -> CAST(-1e4 * p AS DOUBLE)), 'from', transform(sequence(0, {n}), p -> greatest(p - 1, 0)))"
    better = "st.sum[x.s] + x.score > st.sum[x.e]"
    relax = f"""
        if({better},
           named_struct('sum', transform(st.sum, (v, p) -> if(p = x.e, st.sum[x.s] + x.score, v)),
                        'from', transform(st.from, (v, p) -> if(p = x.e, x.s, v))), st)"""
    back = f"""
        aggregate(sequence(1, {n}), named_struct('cuts', shiftleft(1L, {n}), 'at', {n}),
                  (b, i) -> if(b.at = 0, b, named_struct('cuts', b.cuts | shiftleft(1L, st.from[b.at]), 'at', st.from[b.at])), b -> b.cuts)"""
    return f"aggregate({edges}, {start}, (st, x) -> {relax}, st -> {back})"


def lattice_ids(units: DataFrame, path: str, keys: list[str], carried: list[str], kind: str = "bpe") -> DataFrame:
    """``keys, carried, ids`` for ``units`` of at most ``LONG`` characters (column ``unit``, one of the keys)."""
    spark, model = units.sparkSession, pieces(path)
    table = [("", 0, 0, 0.0)] + [(p, i, model.ranks[p], model.scores[p]) for p, i in model.ids.items()]
    dictionary = F.broadcast(spark.createDataFrame(table, "piece string, id int, rank int, score double"))
    n = "char_length(unit)"
    # the empty substring keeps units that no piece is part of
    spans = (
        units.select(*keys, *carried, F.explode(F.expr(f"sequence(-1, {n} - 1)")).alias("s"))
        .select(*keys, *carried, "s", F.explode(F.expr(f"if(s < 0, array(0), sequence(s + 1, least({n}, s + {model.longest})))")).alias("e"))
        .select(*keys, *carried, "s", "e", F.expr("substring(unit, s + 1, e - greatest(s, 0))").alias("piece"))
    )
    # one number for each match: rank, first place, end, id; in this order the best merge is the least
    packed = "shiftleft(CAST(rank AS BIGINT), 29) | shiftleft(CAST(greatest(s, 0) AS BIGINT), 23) | shiftleft(CAST(e AS BIGINT), 17) | id"
    match = F.expr(packed) if kind == "bpe" else F.struct(F.expr(packed).alias("k"), "score")
    edges = spans.join(dictionary, "piece").groupBy(*keys).agg(F.collect_list(match).alias("lattice"), *[F.first(c).alias(c) for c in carried])
    if kind == "bpe":
        steps = f"""transform(filter(lattice, x -> {_END} - {_START} > 1), x -> named_struct('k', x,
            'm', shiftleft(1L, {_END}) - shiftleft(1L, {_START} + 1), 'b', shiftleft(1L, {_END}) | shiftleft(1L, {_START})))"""
        cuts, numbers = bpe_fold("steps", n), F.col("lattice")
    else:
        ends = _END.replace("x", "x.k"), _START.replace("x", "x.k")
        steps = f"array_sort(transform(filter(lattice, x -> {ends[0]} > {ends[1]}), x -> named_struct('e', {ends[0]}, 's', {ends[1]}, 'score', x.score)))"
        cuts, numbers = viterbi_fold("steps", n), F.expr("transform(lattice, x -> x.k)")
    unknown = (
        f"array({model.unknown})"
        if model.first_byte is None
        else f"transform(sequence(1, octet_length(ch)), k -> {model.first_byte} + CAST(conv(substring(hex(encode(ch, 'utf-8')), 2 * k - 1, 2), 16, 10) AS INT))"
    )
    ids = f"""flatten(transform(filter(sequence(0, {n} - 1), a -> (cuts & shiftleft(1L, a)) <> 0), a ->
        element_at(transform(array(cuts & ~(shiftleft(1L, a + 1) - 1L)), rest ->
          element_at(transform(array(filter(numbers, x -> (x & 536739840L) = a * 8388608L + bit_count((rest & -rest) - 1L) * 131072L)), hit ->
            if(size(hit) > 0, array(CAST(hit[0] & 131071L AS INT)),
               element_at(transform(array(substring(unit, a + 1, 1)), ch -> {unknown}), 1))), 1)), 1)))"""
    return edges.withColumn("numbers", numbers).withColumn("steps", F.expr(steps)).withColumn("cuts", F.expr(cuts)).select(*keys, *carried, F.expr(ids).alias("ids"))


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", kind: str = "bpe") -> DataFrame:
    """``doc_id, ids`` of each row: the model's ids of the whole text."""
    spark = df.sparkSession
    out, key = scratch_path(spark, "unit-numbers"), df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    read = rows.mapInArrow(_numbered(path, out), "chunk long, bucket int, n int, units binary")
    cells = materialize(read, "cells")
    total = cells.agg(F.sum("n").alias("n"), F.countDistinct("chunk").alias("chunks")).first()
    of_set = F.pmod(F.xxhash64("chunk"), F.lit(max(1, total.chunks // SPREAD))).cast("int")
    cells = cells.select(of_set.alias("part"), "bucket", "chunk", "units")

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        found = sorted({u for data in table["units"].to_pylist() for u in _unpacked_units(data) if len(u) <= LONG})
        return pa.table({"part": pa.array([key[0].as_py()] * len(found), pa.int32()), "bucket": pa.array([key[1].as_py()] * len(found), pa.int32()), "unit": pa.array(found, pa.string())})

    units = cells.groupBy("part", "bucket").applyInArrow(distinct, "part int, bucket int, unit string")
    units = units.repartition(max(8, (total.n or 0) // PART_UNITS + 1), "unit", "part")
    coded = lattice_ids(units, path, ["unit", "part"], ["bucket"], kind).select("part", "bucket", "unit", "ids")

    def carried(key: tuple, table: pa.Table, coded: pa.Table) -> pa.Table:
        model, k = pieces(path), coded["ids"].combine_chunks()
        of_long = model.merged if kind == "bpe" else model.best
        values, at = k.flatten().to_numpy(), np.concatenate([[0], np.cumsum(k.value_lengths().to_numpy())])
        ids = {u: values[at[i] : at[i + 1]] for i, u in enumerate(coded["unit"].to_pylist())}
        packed = []
        for data in table["units"].to_pylist():
            found = [np.asarray(of_long(u) if len(u) > LONG else ids[u], "<i4") for u in _unpacked_units(data)]
            sizes = np.array(list(map(len, found)), "<i4")
            packed.append(_packed_numbers(np.concatenate([np.array([len(found)], "<i4"), sizes, *found])))
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "ids": pa.array(packed, pa.binary())})

    back = cells.groupBy("part", "bucket").cogroup(coded.groupBy("part", "bucket")).applyInArrow(carried, "chunk long, bucket int, ids binary")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out)
        chunk, found = None, []

        def finished() -> Iterator[pa.RecordBatch]:
            with fs.open_input_stream(f"{base}/{chunk}") as f:
                p = pickle.loads(zstandard.decompress(f.read()))
            p |= {k: _unpacked_numbers(p[k]) for k in ("lengths", "segments", "sizes", "units")}
            sizes = np.concatenate([x[1 : 1 + x[0]] for x in found]).astype("i8")
            flat = np.concatenate([x[1 + x[0] :] for x in found])
            if len(sizes) != p["distinct"]:
                raise ValueError(f"{chunk}: units are missing")
            a = np.cumsum(sizes) - sizes
            seg_ids, seg_sizes = _gathered(flat, a, sizes, p["units"], p["sizes"])
            b = np.cumsum(seg_sizes) - seg_sizes
            bounds = np.concatenate([[0], np.cumsum(p["lengths"], dtype="i8")])
            for k in range(0, len(p["ids"]), 256):
                stop = min(k + 256, len(p["ids"]))
                doc, doc_sizes = _gathered(seg_ids, b, seg_sizes, p["segments"][bounds[k] : bounds[stop]], p["lengths"][k:stop])
                offsets = np.concatenate([[0], np.cumsum(doc_sizes)]).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["ids"][k:stop], kind_of), pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc))], ["doc_id", "ids"]
                )

        for batch in batches:
            for c, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield from finished()
                    chunk, found = c, []
                found.append(_unpacked_numbers(ids).view("<i4"))
        if chunk is not None:
            yield from finished()
        found = []
        released()

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(df.schema[doc_id].dataType)
    parts = max(8, 2 * spark.sparkContext.defaultParallelism, total.chunks)
    return (
        back.repartition(parts, "chunk")
        .sortWithinPartitions("chunk", "bucket")
        .select("chunk", "ids")
        .mapInArrow(documents, f"doc_id {key}, ids array<int>")
    )


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, take: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``take`` of ``flat`` one after the other, and the lengths of groups of so many runs."""
    n = sizes[take]
    total = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts[take] - total[:-1], n) + np.arange(total[-1])
    ends = np.cumsum(groups, dtype="i8")
    return flat[at], total[ends] - total[ends - groups]


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` as column ``to``, in the place of a column of that name.

    Null ids give null, no ids an empty text, however long a row is; ids that are no UTF-8 together
    give replacement marks; repeated rows give repeated results and an empty table an empty one.
    """
    if to != ids:
        df = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch):
                texts = model.texts(part.column(part.schema.get_field_index(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {to} string")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, n_bytes, text_crc32``: checksums of the ids (as little-endian
    unsigned 32-bit numbers) and of the text decoded from them."""
    encoded = encode(df, path, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch):
                rows = part.column(1)
                texts, sizes = model.texts(rows), rows.value_lengths().to_numpy()
                raw, ends = memoryview(rows.flatten().to_numpy().astype("<u4")).cast("B"), 4 * np.cumsum(sizes)
                columns = [
                    sizes.tolist(),
                    [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)],
                    map(len, texts),
                    map(zlib.crc32, texts),
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "text_crc32"]
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, n_bytes long, text_crc32 long")
