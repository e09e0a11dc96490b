"""Operators without SQL against plain versions, and every query of the folder on the smallest tables."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import common, decontaminate, language, licences, neighbours, personal, pieces, queries, toxicity, wordbpe

from .test_llm import SMALL, _groups, _plain, _set, table


def plain_words(text):
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()).split(" ")


def plain_tiles(doc, item, least):
    """Greedy string tiling word by word: the longest common unmarked run first, by place in the document, then in the item."""
    in_doc, in_item, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in in_doc and q + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < least:
            return out
        n, p, q = best
        in_doc |= set(range(p, p + n))
        in_item |= set(range(q, q + n))
        out.append((p, q, n))


def plain_holding(docs, items, cover):
    """{(doc, item): (tiles, words covered)} of held items."""
    out = {}
    for d, text in docs.items():
        w = [x for x in plain_words(text) if x]
        for i, other in items.items():
            v = [x for x in plain_words(other) if x]
            if not v or not set(v) & set(w):
                continue
            least = min(decontaminate.SEED, len(v))
            if not {tuple(v[k : k + least]) for k in range(len(v))} & {tuple(w[k : k + least]) for k in range(len(w))}:
                continue
            found = plain_tiles(w, v, least)
            covered = sum(n for _, _, n in found)
            if covered >= cover * len(v):
                out[d, i] = (len(found), covered)
    return out


def test_tiling_matches_a_plain_tiler(spark):
    rng = random.Random(3)
    letters = [f"w{k}" for k in range(7)]
    items = {k: " ".join(rng.choices(letters, k=n)) for k, n in enumerate([30, 30, 18, 4, 1, 12, 5])} | {20: "", 21: None, 22: "w1 " * 12}
    docs = {k: " ".join(rng.choices(letters, k=rng.randint(0, 60))) for k in range(40)}
    for k in range(40, 70):
        parts = items[rng.randrange(3)].split()
        cut = rng.randrange(1, len(parts))
        docs[k] = " ".join([*rng.choices(letters, k=9), *parts[cut:], "x", *parts[:cut], *rng.choices(letters, k=9)])
    docs |= {70: None, 71: "", 72: "w1, " * 40, 73: docs[40]}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()) + [(0, items[0])], "item_id long, text string")
    found = decontaminate.contamination(rows.unionByName(rows.where("doc_id = 40")), bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_tiles, r.covered) for r in found} == plain_holding(docs, items, decontaminate.COVER)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    held = {d for d, _ in plain_holding(docs, items, decontaminate.COVER)}
    clean = decontaminate.decontaminated(rows.withColumn("hash", F.lit(1)).withColumn("words", F.lit("w")), bench)
    assert clean.columns == ["doc_id", "text", "hash", "words"] and {r.doc_id for r in clean.collect()} == set(docs) - held
    null = spark.createDataFrame([(None, items[0]), (None, "clean words here"), (5, items[0]), (5, "clean words here")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in decontaminate.decontaminated(null, bench).collect()))) == sorted(map(str, [(None, "clean words here"), (5, "clean words here")]))


def test_common_words_in_all_items_stay_quick(spark):
    bench = spark.createDataFrame([(k, "the " * 20) for k in range(20)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "the " * 5000)], "doc_id long, text string")
    assert decontaminate.contamination(rows, bench).count() == 20


def tiled(doc, item):
    least = min(decontaminate.SEED, len(item))
    h, g = (decontaminate.seed_hashes(common.word_hashes([x.encode() for x in w]), least) for w in (doc, item))
    a, b = np.flatnonzero(np.isin(h, g)), np.flatnonzero(np.isin(g, h))
    return decontaminate.tiles(a, h[a], b, g[b], least)


def test_tiles_of_few_words_are_those_of_a_plain_tiler():
    rng = random.Random(5)
    for _ in range(150):
        letters = [f"w{k}" for k in range(rng.choice([1, 2, 3, 5]))]
        item, doc = rng.choices(letters, k=rng.randint(1, 30)), rng.choices(letters, k=rng.randint(5, 50))
        assert tiled(doc, item) == plain_tiles(doc, item, min(decontaminate.SEED, len(item)))
    item = [f"w{k}" for k in range(40)]
    doc = [*rng.choices(item, k=300), *item[20:], *item[:20], *rng.choices(item, k=300)]
    assert tiled(doc, item) == plain_tiles(doc, item, decontaminate.SEED)


def test_repeated_words_on_both_sides_take_linear_time(spark):
    began = time.time()
    bench = spark.createDataFrame([(1, "the " * 60), (2, "so it goes " * 700)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "the " * 100_000), (2, "so it goes " * 30_000)], "doc_id long, text string")
    found = decontaminate.contamination(rows, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_tiles, r.covered) for r in found} == {(1, 1, 1, 60), (2, 2, 1, 2100)}
    assert time.time() - began < 20


def plain_grams(text):
    """Counts of byte 1- to 3-grams, A-Z lower-cased, other ASCII than letters as one blank."""
    b = bytes(x if x >= 128 else (x | 32) if chr(x).isalpha() else 32 for x in b" " + text.encode() + b" ")
    return Counter(b[k : k + n] for n in (1, 2, 3) for k in range(1 if n == 1 else 0, len(b) - n + 1))


def plain_bin(gram):
    code = int.from_bytes(gram, "big") + (len(gram) << 28)
    return (code * 2654435761 & 0xFFFFFFFF) >> 19


def test_languages_match_plain_vectors(spark):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "der die das und nicht mit", "cc": "один два три и четыре"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(words[n].split(), k=30)), n) for k, n in enumerate(["aa", "bb", "cc"] * 12)]
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "12 34", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert set(model["langs"]) == set(words)
    seen = Counter(b for _, t, _ in rows for b in {plain_bin(g) for g in plain_grams(t)})
    for b in range(language.BINS):
        assert model["idf"][b] == pytest.approx(math.log((len(rows) + 1) / (seen[b] + 1)) + 0.05, abs=1e-5)
    asked = spark.createDataFrame([*rows, (92, "und das ipsum", None), (93, "三 四 五 六 七 八", None), (94, "?!", None)], "doc_id long, text string, lang string")
    for r in language.predict(asked, model).collect():
        counts = Counter()
        for g, n in plain_grams(r.text).items():
            counts[plain_bin(g)] += n
        v = np.zeros(language.BINS)
        for b, n in counts.items():
            v[b] = math.log1p(n) * model["idf"][b]
        cosine = model["centres"] @ (v / np.linalg.norm(v))
        best = int(np.argmax(cosine))
        if r.doc_id == 94:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == model["langs"][best] and r.score == pytest.approx(max(0, cosine[best]), abs=1e-4)
            assert r.rejected == (cosine[best] < model["limit"]) or abs(cosine[best] - model["limit"]) < 1e-4
    assert {r.doc_id for r in language.predict(asked, model).where("rejected").collect()} >= {93, 94}


def test_a_junk_row_does_not_end_rejection(spark):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "der die das und nicht mit"}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(words[n].split(), k=rng.randint(3, 30))), n) for k, n in enumerate(["aa", "bb"] * 300)]
    junk = [(1000 + k, x, "aa") for k, x in enumerate(["один два", "三 四 五", "ωψ χφ", "अआ इई", "אב גד", "กข ฃค"])]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    foreign = spark.createDataFrame([(1, "ابت ثجح خدذ"), (2, "አበገ ደሀወ"), (3, "lorem dolor amet"), (4, "nicht die und")], "doc_id long, text string")
    for table in (own, own.unionByName(spark.createDataFrame(junk[:1], own.schema)), own.unionByName(spark.createDataFrame(junk, own.schema))):
        got = {r.doc_id: r for r in language.predict(foreign, language.train(table)).collect()}
        assert got[1].rejected and got[2].rejected
        assert not got[3].rejected and not got[4].rejected
        assert (got[3].lang_pred, got[4].lang_pred) == ("aa", "bb")


def plain_ratio(word, counts):
    """Log-likelihood ratio of a word by length under two interpolated Kneser-Ney models with shared lower orders.

    ``counts``: by n-gram its count in each class.
    """
    d, top = toxicity.DISCOUNT, toxicity.ORDER
    kept = [g for g in counts if sum(counts[g])]
    tails, heads = defaultdict(set), defaultdict(list)
    for g in kept:
        tails[g[1:]].add(g)
        heads[g[:-1]].append(g)

    def spread(g):
        return max(1, sum(counts[g]) if len(g) == top else len(tails[g]))

    def shared(g):
        if not g:
            return 1 / 256
        if g not in known:
            return 1e-6
        same = heads[g[:-1]]
        low = shared(g[1:]) if len(g) > 1 else 1 / 256
        return (spread(g) - d + d * len(same) * low) / sum(map(spread, same))

    def own(g, c):
        low = shared(g[1:]) if len(g) > 1 else 1 / 256
        same = heads[g[:-1]]
        total, seen = sum(counts[x][c] for x in same), sum(counts[x][c] > 0 for x in same)
        if total:
            return max(1e-12, (max(counts[g][c] - d, 0) + d * seen * low) / total)
        if len(g) == 1:
            return max(1e-12, low)
        return own(g[1:], c) if g[1:] in known else max(1e-12, low)

    known, text, out = set(kept), b" " + word + b" ", 0.0
    for end in range(1, len(text)):
        for n in range(min(top, end + 1), 0, -1):
            g = text[end + 1 - n : end + 1]
            if g in known:
                out += math.log(own(g, 1)) - math.log(own(g, 0))
                break
            totals = [sum(counts[x][c] for x in heads.get(g[:-1], ())) for c in (0, 1)]
            if all(totals):
                freed = [d * sum(counts[x][c] > 0 for x in heads[g[:-1]]) / totals[c] for c in (0, 1)]
                out += math.log(freed[1]) - math.log(freed[0])
                break
    return out / math.sqrt(len(word) + 1)


def test_toxic_ratios_match_plain_kneser_ney(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    rows = docs.select("text", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("class"))
    rows = rows.select(F.substring("text", 1, 300).alias("text"), "class")
    counts = defaultdict(lambda: [0, 0])
    for r in rows.collect():
        for w in set(toxicity.words_of(r.text)):
            t = b" " + w + b" "
            for n in range(1, toxicity.ORDER + 1):
                for k in range(1 if n == 1 else 0, len(t) - n + 1):
                    counts[t[k : k + n]][r["class"]] += 1
    own, whole = toxicity._tables(toxicity.gram_counts(rows))
    words = sorted({w for r in rows.limit(6).collect() for w in toxicity.words_of(r.text)})[:60] + [b"zzq", b"unseen-word", "é".encode()]
    got = toxicity.word_ratios(words, whole)
    want = [plain_ratio(w, counts) for w in words]
    assert np.allclose(got, want, atol=1e-3)


def test_neighbours_of_split_leaves_other_lengths_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 60)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    x = [centres[k % 12] + rng.normal(size=8) for k in range(900)] + [np.ones(8)] * 100
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(2000 + k, [float(k), 1.0, 2.0]) for k in range(7)] + [(3000, []), (3001, [0.0] * 8), (3002, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (5, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asks = (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 2003) | (F.col("vec_id") == 3000)
    found = {}
    for r in neighbours.search(df, asks, top=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {*range(0, 1000, 50), 2000, 2003, 2000} | set()
    assert [v for v, _ in found[2003]] == [2006, 2005, 2004, 2002, 2001, 2000]
    usable = [(i, np.array(v)) for i, v in rows if i is not None and len(v) == 8 and np.isfinite(v).all() and np.any(v)]
    hit = 0
    for q in range(0, 1000, 50):
        mine = next(v for i, v in usable if i == q)
        best = sorted((-float((v * mine).sum()), i) for i, v in usable if i != q)[:20]
        hit += len({i for _, i in best} & {i for i, _ in found[q]})
    assert hit / 400 >= 0.9
    # all hundred copies tie: the smallest ids win
    ones = [i for i, _ in found[950] if _ == pytest.approx(8.0)]
    assert ones == sorted(ones)


COLUMNS = {
    "op1_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op3_minhash_neardup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_licence_scan": {
        "doc_id": "bigint",
        "n_words": "bigint",
        "n_base": "bigint",
        "first_word": "bigint",
        "last_word": "bigint",
        "base_labels": "string",
        "labels": "string",
        "score": "double",
    },
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_keep_their_contract(spark, name):
    out = queries.queries()[name](spark, SMALL)
    kinds = dict(out.dtypes)
    assert COLUMNS.get(name, {}).items() <= kinds.items()
    rows = out.toPandas()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fold = lambda k, n: zlib.crc32(str(k).encode()) % n
    if "doc_id" in rows and name != "op7_decontamination":
        assert sorted(rows["doc_id"]) == sorted(docs)
    if name == "op1_token_counts":
        t = wordbpe.tokenizer(wordbpe.vocabulary_path())
        for r in rows.itertuples():
            n = len(t.encode(docs[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
    elif name == "op2_sentencepiece":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
        for r in rows.itertuples():
            ids = sp.encode(docs[r.doc_id])
            assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            assert (r.n_bytes, r.text_crc32) == (len(sp.decode(ids).encode()), zlib.crc32(sp.decode(ids).encode()))
    elif name == "op3_minhash_neardup":
        want, sets = _groups(docs, 4, 80)
        assert dict(zip(rows["doc_id"], rows["component_id"], strict=True)) == want
        assert dict(zip(rows["doc_id"], rows["n_shingles"], strict=True)) == {k: len(_set(t, 4)) for k, t in docs.items()}
    elif name == "op4_licence_scan":
        for r in rows.itertuples():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[r.doc_id].translate({c: c + 32 for c in range(65, 91)}))
            assert r.n_words == len(w) and r.n_base == sum(w[k : k + len(p.split())] == p.split() for _, p in licences.BASE for k in range(len(w)))
    elif name in ("op5_language_id", "op9_toxicity"):
        n, out_fold = (4, 2) if name.startswith("op5") else (5, 0)
        assert all(r.held_out == (fold(r.doc_id, n) == out_fold) and 0 <= r.score <= 1 for r in rows.itertuples())
        if name == "op9_toxicity":
            assert all(r.predicted == (r.score >= 0.5) for r in rows.itertuples())
        else:
            langs = {r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null").select("lang").distinct().collect()}
            assert set(rows["lang_pred"]) <= langs | {"und"}
            assert all((r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id]))) for r in rows.itertuples())
    elif name == "op6_nearest_neighbours":
        x = {r.vec_id: np.array(r.embedding, "f8") for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
        ids = np.array(sorted(x))
        m, hit = np.stack([x[i] for i in ids]), 0
        assert set(rows["query_id"]) == {i for i in x if i % 20 == 0}
        for q, own in rows.groupby("query_id"):
            own = own.sort_values("rank")
            s = (m * x[q]).sum(axis=1)
            s[ids == q] = -np.inf
            hit += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(own["vec_id"]))
            assert list(own["rank"]) == list(range(1, 21)) and all(abs(v - float((x[i] * x[q]).sum())) < 1e-9 for i, v in zip(own["vec_id"], own["score"], strict=True))
        assert hit / len(rows) >= 0.9
    elif name == "op7_decontamination":
        bench = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
        short = {k: t for k, t in docs.items() if len(t) < 1500}
        want = set(plain_holding(short, bench, decontaminate.COVER))
        assert {(d, i) for d, i in zip(rows["doc_id"], rows["item_id"], strict=True) if d in short} == want
    elif name == "op8_personal_data":
        import hashlib

        for r in rows.itertuples():
            base = _plain(docs[r.doc_id])
            listed = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
            assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    elif name == "op10_token_files":
        t, start = wordbpe.tokenizer(wordbpe.vocabulary_path()), 0
        for r in rows.sort_values("doc_id").itertuples():
            ids = [*t.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_library_on_random_texts(spark):
    """Token counts, token files' pieces and SentencePiece ids of texts drawn from awkward parts."""
    import sentencepiece

    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|x", "|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "É", "ß", "ẞ", "İ", "ﬁ", "日本", "😀", "a", "The", "ing", ".", ",", "...", "1", "23", "-", "_", "\x00", "\x01", "A" * 70, "'s", "x́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)]
    t = wordbpe.tokenizer(wordbpe.vocabulary_path())
    got = {r.doc_id: r.n_tokens for r in wordbpe.token_counts(table(spark, texts), wordbpe.vocabulary_path(), keep=40).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in enumerate(texts)}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids = {r.doc_id: list(r.ids) for r in pieces.encode(table(spark, texts[:300]), pieces.model_path()).collect()}
    assert ids == {k: sp.encode(x) for k, x in enumerate(texts[:300])}
