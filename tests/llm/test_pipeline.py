"""The pipeline against a brute-force version, stage by stage."""

import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from trailweave.llm import decontaminate, language, pieces
from trailweave.llm.common import materialize

from .test_brute import plain_holding
from .test_llm import _groups, _plain

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SMALL), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
            assert all(k in after or not language.has_letter(before[k].text) or len(before[k].text) < 200 for k in before)
        elif name == "near_dedup":
            want, _ = _groups({k: r.text for k, r in before.items()}, 5, 80)
            assert set(after) == set(want.values())
        elif name == "decontamination":
            short = {k: r.text for k, r in before.items() if len(r.text or "") < 1500}
            held = {k for k, _ in plain_holding(short, {i.item_id: i.text for i in bench}, decontaminate.COVER)}
            assert held and set(after) & set(short) == set(short) - held and set(after) <= set(before)
        elif name == "personal_data":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
            for k, r in before.items():
                spans = _plain(r.text)
                for a, _, b in spans:
                    assert r.text[a:b] not in after[k].text or r.text[a:b].isdigit()
                if not spans and not re.search(r"[0-9@+]|dot|\bat\b|[^\x00-\x7f]", r.text, re.I):
                    assert after[k].text == r.text
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
            for k, r in before.items():
                ids = sp.encode(r.text)
                assert list(after[k].ids) == ids and after[k].n_pieces == len(ids) and after[k].decoded == sp.decode(ids)


def test_near_dedup_keeps_one_row_of_a_repeated_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    out = corpus_pipeline.near_dedup(spark, docs.unionByName(docs), SMALL)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids))


def test_near_dedup_keeps_different_texts_of_a_repeated_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey pink")
    rows = [(5, a), (5, b), (7, b), (9, c), (9, c.upper()), (11, c), (None, a), (13, None), (13, ""), (2, a + " " + c), (2, b)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    want = [(2, a + " " + c), (2, b), (5, a), (9, c.upper()), (13, None), (None, a)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected string, node string, _set string, decoded string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_cases(spark, name):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing names, empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    learnt = [(k, f"the cat and the dog number {k % 5} went home to the hill again", "en", "s", 9, "x", "y", "z", "w", "i") for k in range(20, 40)]
    odd = [(1, None, None, None, None, None, None, None, None, None), (None, None, "en", "s", 0, "x", "y", "z", "w", "i"), (2, "", "en", "s", 0, "x", "y", "z", "w", "i")]
    odd += [(3, "the cat " * 40_000, "en", "s", 1, "x", "y", "z", "w", "i"), (4, "\n \t", None, "s", 1, "x", "y", "z", "w", "i"), (5, "x" * 200_000, "en", "s", 1, "x", "y", "z", "w", "i")]
    rows = spark.createDataFrame([*learnt, *learnt[:3], *odd, *odd[:1]], CLASHING)
    for df in (rows, rows.where("false")):
        out = stage(spark, df, SMALL)
        kept = out.collect()
        if name != "sentencepiece":
            assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
            assert {r.doc_id for r in kept} <= {r.doc_id for r in df.collect()}
        else:
            assert out.columns == ["doc_id", "n_pieces", "ids", "decoded"] and len(kept) == df.count()
            assert all(r.decoded == "" and r.n_pieces == 0 for r in kept if r.doc_id in (1, 2, None))
        if name == "language_id":
            assert not any(r.doc_id in (1, 2, 4) for r in kept)
        if name == "near_dedup" and kept:
            assert sorted(r.doc_id for r in kept if r.doc_id in range(20, 40)) == [20, 21, 22, 23, 24] and any(r.doc_id is None for r in kept)
        if name in ("decontamination", "personal_data"):
            assert len(kept) == df.count()


def test_run_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
