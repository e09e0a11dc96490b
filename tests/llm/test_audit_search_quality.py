"""Filter audit, lexical search and quality against plain versions, SQL and held-out labels."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import audit, lexical, quality, queries

from .test_llm import SMALL

DOCS = "doc_id long, text string, lang string, source string, part string, fails string, digest string, n string, term string, good string"
LABELS = "doc_id long, quality int, toxic int, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "p", "f", "d", "n", "t", "g") for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_lexical_search"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = queries.queries()[name](spark, SMALL)
    want = con.sql(queries.oracle_sql()[name])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    seen = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        seen.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            before = set(order[: step - 1])
            for part, fails, g, x in seen:
                c = out.setdefault((part, order, step), Counter())
                there = not fails & before
                c["kept"] += there and f not in fails
                c["removed"] += there and f in fails
                c["redundant"] += not there and f in fails
                c["unique_fails"] += fails == {f}
                c["good_lost"] += there and f in fails and g
                c["toxic_lost"] += there and f in fails and x
    share = Counter()
    for (part, order, step), c in out.items():
        share[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(int(c[n]) for n in names), share[p, o[s - 1]]) for (p, o, s), c in out.items())


def test_audit_matches_a_plain_count(spark):
    rng = random.Random(5)
    long = [" ".join(rng.choice(["alpha", "beta\t", "É", "x#"[: rng.randint(1, 2)], "Q", *[f"w{k}" for k in range(300)]]) for _ in range(rng.choice([5, 199, 200, 400]))) for _ in range(30)]
    texts = [*long, None, "", " \n", "AAAA", "a|b", long[0], "x " * 200_000]
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)] + [(k + 100, rng.choice(texts), "en") for k in range(40)]
    rows += [(None, long[0], "en"), (None, None, None), (3, long[0], "de"), (0, long[0], "en"), (0, long[0], "en"), (-7, long[1], None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "n") for k in range(0, 120, 2)] + [(0, 1, 0, "n"), (0, 0, 1, "n"), (None, 1, 1, "n")]
    found = audit.filter_audit(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, [r[:3] for r in labels])
    none = spark.createDataFrame([], LABELS)
    assert audit.filter_audit(documents(spark, []), none).count() == 0
    alone = audit.filter_audit(documents(spark, [(1, "a", "en")]), none).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in alone] == [(0, 1, 0, 1, 120)] + [(0, 0, 0, 0, 0)] * 4


def plain_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(x), len(x)) for i, t in rows if (x := terms(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,block,limit,top", [(16_384, 200_000, 1_000_000, 50), (40, 10, 1_000_000, 5), (7, 200_000, 3, 3)])
def test_search_matches_a_plain_one(spark, shard_docs, block, limit, top):
    rng = random.Random(shard_docs)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "ABC", "a1"]
    chance = [1 / (k + 1) for k in range(len(words))]
    rows = [(k, " ".join(rng.choices(words, chance, k=rng.choice([1, 3, 20, 200]))) + rng.choice(["", ".", "\x00x"])) for k in range(300)]
    rows += [(k + 1000, "w1 w50, w3") for k in range(80)] + [(None, "w50 w50"), (None, "w1 w50, w3"), (7, "w50 w3"), (7, "w50 w3"), (900, None), (901, ""), (902, "?!"), (903, "w7 " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 15])))) for k in range(12)] + [(20, None), (21, "..."), (22, "unseen"), (23, "w1 w50"), (23, "w3"), (23, "w3"), (None, "w50")]
    docs = documents(spark, [(i, t, "en") for i, t in rows]).repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    found = lexical.search(docs, asked, top, block, limit, shard_docs)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(rows, items, top)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(documents(spark, []), items).count() == 0
    assert lexical.search(documents(spark, [(1, "a", "en"), (2, None, "en")]), items.limit(0)).count() == 0


def test_blocks_have_the_least_overestimate():
    rng = np.random.default_rng(2)

    def plain(x, cost):
        error, back = [0.0], [0]
        for i in range(1, len(x) + 1):
            options = [(error[j] + cost + x[j:i].max() * (i - j) - x[j:i].sum(), j) for j in range(max(0, i - lexical.LONGEST), i)]
            error.append(min(options)[0])
            back.append(min(options)[1])
        return error[-1]

    rows = [rng.integers(1, 1000, n) for n in (1, 2, 17, 130)] + [np.full(200, 7), np.repeat([5, 900, 30], 40)]
    x = np.full((len(rows), 200), -1.0)
    for r, v in enumerate(rows):
        x[r, : len(v)] = v
    cost = np.array([50.0, 200.0, 900.0, 2000.0, 1.0, 100.0])
    for v, c, ends in zip(rows, cost, lexical._cut(x, cost), strict=True):
        begins = np.concatenate([[0], ends[:-1]])
        got = sum(c + v[a:b].max() * (b - a) - v[a:b].sum() for a, b in zip(begins, ends, strict=True))
        assert ends[-1] == len(v) and (ends - begins).max() <= lexical.LONGEST and abs(got - plain(v, c)) < 1e-6
    assert lexical._cut(x, cost)[-1].tolist() == [40, 80, 120]
    sizes = np.array([3, 1300, 1])
    cut = lexical.blocks(rng.integers(1, 99, 1304), np.array([0, 3, 1303]), sizes)
    assert [c[-1] for c in cut] == sizes.tolist() and all((np.diff(c) > 0).all() for c in cut)


def test_search_skips_blocks():
    rng = np.random.default_rng(4)

    def made(place, impact, weight):
        ends = lexical.blocks(impact, np.array([0]), np.array([len(impact)]))[0]
        bounds = np.maximum.reduceat(impact, np.concatenate([[0], ends[:-1]]))
        return lexical.Postings(*map(lexical.packed, (np.diff(place, prepend=0), impact, ends, bounds)), weight, 10)

    n, read = 16_000, []
    impact = rng.integers(1, 100, n)
    impact[4000:4040] = 900_000
    common, rare = made(np.arange(n), impact, 3), made(np.arange(50, n, 400), np.full(40, 100), 9000)
    for x in (common, rare):
        x.read = lambda live, f=x.read: read.append((got := f(live))[0].size) or got
    places, scores = lexical.best([common, rare], n, 10)
    score = impact * 3
    score[np.arange(50, n, 400)] += 100 * 9000
    want = sorted(range(n), key=lambda k: (-score[k], k))[:10]
    assert set(want) <= set(places.tolist()) and scores.tolist() == score[places].tolist()
    assert sum(read) < n / 4


def test_quality_is_right_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(quality.training_rows(docs, labels))
    assert len(model["good"]) <= quality.DICTIONARY and len(model["bad"]) <= quality.DICTIONARY
    held = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1).join(labels, "doc_id")
    known = {r.doc_id: r.quality for r in held.collect()}
    found = quality.predict(held, model).collect()
    assert sum(r.predicted == known[r.doc_id] for r in found) / len(found) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert sum(r.predicted for r in found if known[r.doc_id]) / sum(known.values()) > 0.95
    plain = quality.Packers(model["good"], model["bad"])
    odd = documents(spark, [(1, None, "en"), (2, "", "en"), (3, "x" * 3_000_000, "en"), (3, "y", "en"), (None, "y", "en")])
    got = quality.predict(odd, model).collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, None] and got[0].score == got[1].score
    assert [r.difference for r in got] == [0.0, 0.0, plain.difference(b"x" * 3_000_000), *[plain.difference(b"y")] * 2]
    assert quality.predict(odd.limit(0), model).count() == 0


def test_quality_without_labels_of_both_classes(spark):
    docs = documents(spark, [(k, f"words {k} of a text", "en") for k in range(30)])
    of = lambda rows: quality.predict(docs, quality.train(quality.training_rows(docs, spark.createDataFrame(rows, LABELS)))).collect()
    assert {r.score for r in of([(k, 1, None, "n") for k in range(9)])} == {1.0}
    assert {r.score for r in of([(k, 0, None, "n") for k in range(9)])} == {0.0}
    assert {(r.score, r.predicted) for r in of([(1, None, 0, "n"), (None, 1, 0, "n")])} == {(0.5, 1)}
    mixed = of([(0, 1, 0, "n"), (2, 0, 0, "n"), (2, 1, 0, "n"), (3, 0, 0, "n"), (3, None, 0, "n"), (4, 0, None, "n")])
    assert len(mixed) == 30 and all(0 <= r.score <= 1 for r in mixed)
