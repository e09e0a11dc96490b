"""The operators against the libraries, brute force, and edge cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.llm import common, decontaminate, language, licences, neardup, neighbours, personal, pieces, tokenfiles, toxicity, wordbpe

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, component_id string"
ODD = [None, "", " ", "\n\t", "a", "the the the the the", "x" * 5000, "É" * 300, "1 2 3", "日本 語", "<|endoftext|> <|ENDOFTEXT|>", "<s> ▁ <0x41>", "ẖ, a.b"]


def table(spark, texts):
    rows = [(k, t, "en", "s", len(t or ""), "n", "s", "c") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_token_counts_and_files_match_the_library(spark, tmp_path, texts):
    path = wordbpe.vocabulary_path()
    t = wordbpe.tokenizer(path)
    df = table(spark, ODD + list(texts.values())[:40])
    known = {r.doc_id: r.text or "" for r in df.collect()}
    ids = {k: t.encode(x, add_special_tokens=False).ids for k, x in known.items()}
    for r in wordbpe.token_counts(df, path, keep=50).collect():
        assert (r.n_bytes, r.n_tokens) == (len(known[r.doc_id].encode()), len(ids[r.doc_id]))
    tokenfiles.write_token_files(df, path, f"file://{tmp_path}/t", end_id=2)
    start = 0
    rows = tokenfiles.read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("doc_id").collect()
    assert len(rows) == len(known)
    for r in rows:
        want = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_piece_table_encodes_stems_once(monkeypatch):
    """Each word and each closing punctuation goes to the library once; pieces in use outlive a full cache."""
    path, encode, seen = wordbpe.vocabulary_path(), wordbpe.encode_pieces, []
    monkeypatch.setattr(wordbpe, "encode_pieces", lambda p, x: seen.extend(x) or encode(p, x))
    t = wordbpe.tokenizer(path)

    def ids(piece):
        return np.array(t.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    words = ["alpha", "beta", "schö", "niño", "год", "x1"]
    endings = ["", ".", "***", "&&&", "!?", ').', "'"]
    found = [[w + e for e in endings] + [w[0].upper() + w[1:] + e for e in endings if w.isascii()] for w in words]
    rows = wordbpe.PieceTable(path).lookup([[p.encode() for p in x] for x in found])
    assert rows == [[ids(p) for p in x] for x in found]
    assert sorted(seen) == sorted(x.encode() for x in words + endings[1:])

    monkeypatch.setattr(wordbpe, "CACHED", 40)
    table, seen[:] = wordbpe.PieceTable(path), []
    for k in range(30):
        new = [f"w{k}q{j}".encode() for j in range(10)]
        assert table.lookup([[b"often", *new]]) == [[ids("often"), *(ids(p.decode()) for p in new)]]
    assert seen.count(b"often") == 1 and len(seen) == 301
    assert len(table.found) + len(table.older) <= 40 + 2 * 12


def test_pieces_have_the_ids_of_their_stems():
    """Punctuation after letters, capitals before combining marks, letters that fall apart: held to the library."""
    path, rng = wordbpe.vocabulary_path(), random.Random(9)
    parts = ["<|endoftext|>", "<|", "|>", " ", "\x85", "\xa0", "é", "É", "ß", "ẞ", "İ", "ŉ", "×", "÷", "ﬁ", "日", "“", "’", "…", "a", "B", "J", "H", "ing"]
    parts += [".", ",", "!?", "***", "'", "'s", "'S", "'re", "=", "1", "²", "-", "_", "\x01", "x", "\u030c", "\u0301", "\u0307", "\u0331", "\u0338", "Й", "и", "\u0306", "҂", "Å", "יִ", "ſ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(10_000)]
    rows = wordbpe.PieceTable(path).lookup([x.encode().split() for x in texts])
    for x, row, e in zip(texts, rows, wordbpe.tokenizer(path).encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert b"".join(row) == np.array(e.ids, "<u4").tobytes(), x


def test_shards_are_written_once(spark, tmp_path):
    df = table(spark, [f"text {k}" for k in range(3000)]).repartition(4)
    manifest = tokenfiles.write_token_files(df, wordbpe.vocabulary_path(), f"file://{tmp_path}/s", end_id=2)
    listed = [s["file"] for s in manifest["shards"]]
    assert len(listed) > 1 and listed == sorted(listed)
    assert sorted(p.name for p in (tmp_path / "s").glob("shard-*")) == listed
    rows = tokenfiles.read_token_files(spark, f"file://{tmp_path}/s").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(3000))
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(3000)]


def test_dictionary_is_drawn_from_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tokenfiles.zstandard, "train_dictionary", lambda size, samples, level: seen.extend(samples) or (_ for _ in ()).throw(ValueError))
    path = wordbpe.vocabulary_path()
    text = "alpha " * 30_000 + "omega " * 30_000
    assert tokenfiles.train_dictionary(table(spark, [text, "short"]), path) == b""
    ids = {w: wordbpe.tokenizer(path).encode(w, add_special_tokens=False).ids for w in ("alpha", "omega", "short")}
    drawn = sorted((np.frombuffer(s, "<u4") for s in seen), key=len)
    assert list(drawn[0]) == ids["short"] and len(drawn[1]) == tokenfiles.SAMPLE_IDS
    assert set(ids["alpha"]) <= set(drawn[1].tolist()) and set(ids["omega"]) <= set(drawn[1].tolist())


def test_empty_tables(spark, tmp_path):
    df = table(spark, ["x"]).where("doc_id < 0")
    path = wordbpe.vocabulary_path()
    assert wordbpe.token_counts(df, path).count() == 0
    tokenfiles.write_token_files(df, path, f"file://{tmp_path}/e", end_id=2)
    assert tokenfiles.read_token_files(spark, f"file://{tmp_path}/e").count() == 0
    assert neardup.near_duplicates(df).count() == 0
    assert licences.licence_report(df).count() == 0
    assert personal.personal_data(df).count() == 0
    assert pieces.round_trip(df, pieces.model_path()).count() == 0
    assert decontaminate.contamination(df, table(spark, ["a b c d e"]), item_id="doc_id").count() == 0
    assert decontaminate.contamination(table(spark, ["a"]), df, item_id="doc_id").count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(empty, F.lit(True)).count() == 0
    assert language.predict(df.select("doc_id", "text"), language.train(df)).count() == 0
    model = toxicity.train(df.withColumn("toxic", F.lit(1)).withColumn("back", F.lit(True)))
    assert toxicity.predict(df, model).count() == 0


def test_piece_sequence_rules_match_the_library():
    import sentencepiece

    path = pieces.model_path()
    p, sp = pieces.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    parts = ["▁", " ", "  ", "a", "the", "ing", "é", "日", "😀", "\n", "\x00", "</s>", "<0x41>", "B", "́", "23", "--", "==", "aaaa", "\xa0", ".", ","]
    texts = ["", None, "▁▁", " ", "a ", " a", *("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000))]
    found = []
    for words in pieces._words(pa.array(texts)).to_pylist():
        units, sizes = p.units(words) if words else ([], [])
        assert sum(sizes) == len(units) and len(sizes) == len(words)
        found.append([i for u in units for i in p.merged(u)])
    assert found == [sp.encode(x or "") for x in texts]
    assert [t.decode() for t in p.texts(pa.array(found, pa.list_(pa.int32())))] == [sp.decode(i) for i in found]
    assert p.texts(pa.array([[], None, found[8]], pa.list_(pa.int32()))) == [b"", None, sp.decode(found[8]).encode()]


def test_lattice_encoding_matches_the_library(spark, texts):
    import sentencepiece

    path = pieces.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = table(spark, ODD + ["a" * 70 + " " + "ab" * 40] + list(texts.values())[:30])
    out = pieces.decode(pieces.encode(df, path), path).collect()
    known = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(out) == len(known)
    for r in out:
        assert list(r.ids) == sp.encode(known[r.doc_id])
        assert r.decoded == sp.decode(list(r.ids)) == known[r.doc_id].replace("▁", " ")


def test_viterbi_fold_takes_the_best_sum(spark):
    edges = "array(named_struct('e',1,'s',0,'score',-1D),named_struct('e',2,'s',1,'score',-1D),named_struct('e',2,'s',0,'score',-3D),named_struct('e',3,'s',2,'score',-1D),named_struct('e',3,'s',1,'score',-1.5D))"
    sql = pieces.viterbi_fold("edges", "3")
    cuts = spark.sql(f"SELECT {edges} AS edges").select(F.expr(sql).alias("c")).first().c
    assert cuts == 0b1011


def test_unigram_encoding_of_short_and_long_units_matches_the_library(spark, tmp_path, texts):
    import sentencepiece

    lines = tmp_path / "lines.txt"
    lines.write_text("\n".join(t[:2000].replace("\n", " ") for t in texts.values() if t))
    path = str(tmp_path / "u.model")
    sentencepiece.SentencePieceTrainer.train(
        input=str(lines), model_prefix=path[:-6], model_type="unigram", vocab_size=800, hard_vocab_limit=False, byte_fallback=True,
        normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2,
    )
    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.pieces(path), random.Random(2)
    known = [w for t in texts.values() if t for w in t.split()][:400]
    cases = [" ".join(known[:80]), *("".join(rng.choices(known, k=40)) for _ in range(12)), "re" * 80, "é日" * 3 + "the"]
    units = [u for x in cases for u in model.units(x.split())[0]]
    assert any(len(u) > pieces.LONG for u in units) and any(len(u) > pieces.LONG and model.best(u) != model.merged(u) for u in units)
    for x in cases:
        assert [i for u in model.units(x.split())[0] for i in model.best(u)] == sp.encode(x)
    for r in pieces.encode(table(spark, cases), path, kind="unigram").collect():
        assert list(r.ids) == sp.encode(cases[r.doc_id])


def _set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _groups(known, k, percent):
    root = {i: i for i in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: _set(t, k) for i, t in known.items()}
    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in known}, sets


@pytest.mark.parametrize(("k", "block", "many"), [(4, neardup.BLOCK, 10_000), (5, 8, 10_000), (4, 8, 3)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, texts, k, block, many):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FIRST", block)
    rng = random.Random(k)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    copies = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = "new" + str(rng.random())
        copies.append(" ".join(w))
    df = table(spark, ODD + ["a b c", "a b c", "A B  c", "a b c d e f", "a b c d e f g"] + copies + copies[:5] + list(texts.values())[:60])
    known = {r.doc_id: r.text for r in df.collect()}
    want, sets = _groups(known, k, 80)
    rows = neardup.near_duplicates(df, k=k, percent=80, many=many).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (9, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(5, 5, True), (5, 5, True), (None, None, True), (7, 5, False), (9, 9, True)], key=str)


def test_register_estimate_is_close():
    rng = np.random.default_rng(3)
    both = np.unique(neardup._mix(rng.integers(0, 1 << 62, 3000).astype("u8")))
    a, b = both[:2600], both[400:]
    true = len(np.intersect1d(a, b)) / len(both)
    assert abs(neardup.estimate(neardup.registers(a), neardup.registers(b), len(a), len(b)) - true) < 0.15


def _licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _licence_labels(text, idf):
    """Brute force: every start of every template, its phrases and its cover."""
    w, found = _licence_words(text), []
    for label, t, keys in licences.TEMPLATES:
        t = t.split()
        total = sum(idf[x] for x in t)
        for d in range(-len(t), len(w)):
            near = lambda q: w[max(0, d + q - licences.DRIFT) : max(0, d + q + licences.DRIFT + 1)]  # noqa: B023, E731
            cover = sum(idf[x] / total for q, x in enumerate(t) if x in near(q))
            held = []
            for key in map(str.split, keys):
                q = next(k for k in range(len(t)) if t[k : k + len(key)] == key)
                held.append(any(d + q + o >= 0 and w[d + q + o : d + q + o + len(key)] == key for o in range(-licences.DRIFT, licences.DRIFT + 1)))
            if all(held) and cover >= licences.COVERAGE:
                found.append(label)
    return set(found)


def test_licences_match_brute_force(spark):
    whole = [t for _, t, _ in licences.TEMPLATES]
    near_misses = ["licensed under the apache license", "released under the MIT License", "this work is licensed under the GNU General Public License, version 3.", "mit. License", "free and unencumbered"]
    broken = [" ".join(x for k, x in enumerate(t.split()) if k % 2) for t in whole]
    shifted = [f"a b all c {t.replace(' the ', ' the very ', 1)} the the of" for t in whole]
    cases = [*ODD, "CC BY", "x cc-by y CC.BY", "GNU General  Public\nLicense", "all rights reserved. All Rights Reserved", "license " * 50, "general public"]
    cases += [*near_misses, *whole, *broken, *shifted, " x ".join(whole), "the of to " * 3000 + whole[9] + " the" * 3000]
    df = table(spark, cases)
    idf = licences.word_idf(df)
    for r in licences.licence_report(df).collect():
        w = _licence_words(cases[r.doc_id])
        found = [(k, label) for label, p in licences.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == (min((k for k, _ in found), default=None), max((k for k, _ in found), default=None))
        base = {x for _, x in found}
        assert r.base_labels == ",".join(sorted(base))
        if len(w) < 1500:
            assert r.labels == ",".join(sorted(base | _licence_labels(cases[r.doc_id], idf))), cases[r.doc_id]
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
    assert "mit" in licences.licence_report(df).where(f"doc_id = {len(cases) - 1}").first().labels
    index = licences.postings(licences.templates(idf))
    isc = next(k for k, t in enumerate(licences.templates(idf)) if t["label"] == "isc")
    assert (isc, 3) in {(x["t"], x["q"]) for x in index["copy"]}


def test_licence_scan_takes_time_in_proportion(spark):
    """Notices that repeat short statements thousands of times, and all licences in one file hundreds of times."""
    statement = "all rights reserved mit license general public license "
    notice = " x ".join(t for _, t, _ in licences.TEMPLATES)
    few = table(spark, [statement * 40, f"{notice} " * 2])
    idf = licences.word_idf(few)
    licences.licence_report(few).collect()
    for text, part in ((statement * 5000, statement * 2), (f"{notice} " * 500, f"{notice} " * 2)):
        df = table(spark, [text]).select("doc_id", "text")
        began = time.time()
        r = licences.licence_spans(df, idf=idf).select(F.expr("size(filter(_spans, s -> s.base))").alias("n"), F.expr("array_distinct(transform(_spans, s -> s.label))").alias("labels")).first()
        assert time.time() - began < 20, len(text)
        w = _licence_words(text)
        assert r.n == sum(w[k : k + len(p.split())] == p.split() for _, p in licences.BASE for k in range(len(w)))
        assert set(r.labels) == {label for label, p in licences.BASE if p in part.replace(" x ", " ")} | _licence_labels(part, idf)


def test_licence_identifiers_and_columns(spark):
    cases = {
        "// SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "licensed under the BSD 2-Clause License": "bsd-2-clause",
        "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
        "made available under the terms of the Eclipse Public License 2.0": "epl-2.0",
        "licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "an ordinary text": "",
    }
    df = spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(cases)], "doc_id long, text string, _words string, _words_all string, _hits string")
    idf = licences.word_idf(df)
    found = licences.licence_spans(df, idf=idf)
    assert {*df.columns} < {*found.columns}
    for r in found.collect():
        assert ",".join(sorted({s.label for s in r._spans})) == list(cases.values())[r.doc_id]
        assert (r._words, r._words_all, r._hits) == ("a", "b", "c")


def _plain(text):
    luhn = personal._luhn
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_plain_spans_match_the_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        x = "".join(rng.choices(["a", "b@", "@", ".", "c.d", "1", "25", "1.2.3.4", "+", "-", " ", "_", "4539 1488 0343 6467", "(", ")", "é", "+1 (555) 123-4567", "@x.y"], k=rng.randint(0, 14)))
        assert personal.plain_spans(x) == _plain(x), x


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to jane dot doe (at) example [dot] com today", "email", "example [dot] com"),
        ("mail bob at example dot org now", "email", "bob at example dot org"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five"),
        ("usеr@examрle.com is disguised", "email", "usеr@examрle.com"),
        ("host １９２.168.0.1 here", "ip", "１９２.168.0.1"),
    ],
)
def test_disguises_are_mapped_back(text, kind, part):
    spans = personal.spans_of(text)[1]
    assert any(personal.KINDS[k] == kind and part in text[a:b] for a, k, b in spans), spans
    assert f"[{kind.upper()}]" in personal.redact(text)
    assert personal.spans_of("the loop at dawn and a dot on the map, one two")[1] == []


@pytest.mark.parametrize("word", ["dot", "DOT", "punto", "point", "punkt", "."])
@pytest.mark.parametrize(("left", "right"), ["()", "[]", "{}", "<>"])
@pytest.mark.parametrize("inner", ["", " ", "  \t"])
def test_bracketed_disguises_stand_alone(word, left, right, inner):
    dot = f"{left}{inner}{word}{inner}{right}"
    for at in ("at", "At", "@"):
        for text in (f"jane {left}{inner}{at}{inner}{right} example.com", f"jane@example{dot}com", f"jane {left}{inner}{at}{inner}{right} example {dot} com"):
            assert personal.redact(text) == "[EMAIL]", text
    assert personal.redact(dot.join(["10", "0", "0", "1"])) == "[IP]"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call plus 1 415 five five five 0199 now", "call [PHONE] now"),
        ("call plus 1, 415, five five five, 0199 now", "call [PHONE] now"),
        ("call +1 four one five 555 oh one nine nine now", "call [PHONE] now"),
        ("call plus 1 dot 415 dot five five five dot 0199 now", "call [PHONE] now"),
        ("pay 4539 1488 zero three four three 6467 now", "pay [CARD] now"),
        ("pay four five three nine 1488  0343, six four 67 now", "pay [CARD] now"),
        ("ping 192 dot 168 dot 0 dot 1 now", "ping [IP] now"),
        ("ping one nine two dot 168 [dot] zero dot 1 now", "ping [IP] now"),
        ("ping 192.168.zero.one now", "ping [IP] now"),
        ("ping one.one.one.one now", "ping [IP] now"),
        ("ping １９２ dot 168(punkt)0.one now", "ping [IP] now"),
        ("to jane (at) example dot com now", "to [EMAIL] now"),
        ("to jane@example dot com now", "to [EMAIL] now"),
        ("to jane at example [dot] com now", "to [EMAIL] now"),
        ("to jane at mail dot example.com now", "to [EMAIL] now"),
        ("to jane at example dot co.uk now", "to [EMAIL] now"),
        ("to jane dot doe (at) example [dot] com now", "to [EMAIL] now"),
        ("to jane dot doe at example dot org now", "to [EMAIL] now"),
        ("to jane [dot] m dot doe@example.com now", "to [EMAIL] now"),
        ("to doe@example.co dot uk now", "to [EMAIL] now"),
        ("to jane（at）exаmple dot com now", "to [EMAIL] now"),
        ("to one (at) two dot com now", "to [EMAIL] now"),
        ("look at example.com, one of two; a dot at most", None),
        ("one two three, four five six seven eight. It is 3 dot 5", None),
        ("ſix ſeven fıve one two three four five six seven", None),
    ],
)
def test_mixed_disguises_are_rewritten_whole(text, want):
    assert personal.redact(text) == (want or text)


def test_long_disguised_texts_take_linear_time():
    text = "plus 1 415 five five five 0199; 10 dot 0 dot zero [dot] 1; jane dot doe at example (dot) org; usеr@x.org dot at dot " * 3000
    start = time.process_time()
    assert len(personal.spans_of(text)[1]) >= 4 * 3000 and time.process_time() - start < 20


def test_brackets_and_blanks_take_linear_time():
    start = time.process_time()
    assert personal.redact("(" + " " * 300_000 + "x" + " " * 300_000 + "[dot]") and time.process_time() - start < 5


def test_secrets_are_counted_and_redacted():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'token = "{key}" x', f"API_KEY={key}", f"my-secret: '{key}'", f"the api key = {key}.", f'"password":"{key}"'):
        assert [text[a:b].rstrip(".") for a, b in personal.secret_spans(text)] == [key]
        assert key not in personal.redact(text) and "[SECRET]" in personal.redact(text)
    for text in (None, "", key, f"commit = {key}", "token = short1", "token = onlylettersinthisvalue", f"tokens of {key}", "authority: abcdefghijklmnop1", "= " * 50_000):
        assert personal.secret_spans(text) == [] and personal.redact(text) == text
    began = time.time()
    personal.secret_spans("token = " * 100_000 + ":" * 200_000 + " " * 200_000)
    assert time.time() - began < 2


def test_personal_data_rows(spark):
    cases = [*ODD, "a@b.co and 10.0.0.1 x@y.zz", "4539148803436467"]
    for r in personal.personal_data(table(spark, cases)).collect():
        want = _plain(cases[r.doc_id] or "")
        listed = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans == listed
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = common.fold_of(F.col("doc_id"), 4) == 2
    model = language.train(docs.where(~held))
    rows = language.predict(docs.where(held).select("doc_id", "text", F.col("lang").alias("told")), model).collect()
    assert sum(r.told == r.lang_pred for r in rows) / len(rows) > 0.95
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    odd = {r.doc_id: r for r in language.predict(table(spark, ODD).select("doc_id", "text"), model).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].rejected and odd[k].score == 0 for k in (0, 1, 2, 3, 8))
    assert all(0 <= r.score <= 1 for r in odd.values())


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 16)).astype("f4")
    x[300:500] = x[300]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, top=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    d, hit = x.astype("f8"), 0
    assert set(found) == set(range(0, 800, 20))
    for q, got in found.items():
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(800), -s))[:20]
        hit += len(set(want.tolist()) & {v for v, _ in got})
        assert got == sorted(got, key=lambda p: (-p[1], p[0])) and len(got) == 20
        assert all(abs(v - s[i]) < 1e-9 for i, v in got)
    assert hit / (20 * len(found)) >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.search(few, F.col("vec_id") == 0, top=20).count() == 2


def test_contamination_finds_whole_and_reordered_passages(spark):
    item = " ".join(f"w{k}" for k in range(40))
    half = item.split()
    moved = " ".join([*half[20:40], "between", *half[0:20]])
    docs = table(spark, [*ODD, f"before {item.upper()} after", f"x {moved} y", " ".join(half[:8]) + " else", "the " * 3000])
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny item"), (11, "the the the the the the the the")], "item_id long, text string")
    rows = decontaminate.contamination(docs, items).collect()
    base = len(ODD)
    assert {(r.doc_id, r.item_id) for r in rows} == {(base, 7), (base + 1, 7), (base + 3, 11), (5, 11)} - ({(5, 11)} if 5 / 8 < decontaminate.COVER else set())
    assert next(r for r in rows if r.doc_id == base + 1).n_tiles == 2
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()}
    assert base not in kept and base + 2 in kept


def test_planted_passages_are_caught(spark, docs, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {(d, i.item_id) for i in bench.collect() for d, t in texts.items() if i.text in (t or "")}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    assert want <= found


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(toxicity.training_rows(docs, labels))
    held = docs.where(common.fold_of(F.col("doc_id"), 5) == 0)
    rows = toxicity.predict(held, model).join(labels, "doc_id").collect()
    good = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert good > 0.94, good
    odd = toxicity.predict(table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    none = toxicity.train(toxicity.training_rows(docs.limit(0), labels))
    assert {r.score for r in toxicity.predict(table(spark, ODD), none).collect()} == {0.0}


def test_toxicity_is_the_same_with_a_large_table(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.training_rows(docs, labels)
    small, large = toxicity.train(rows), toxicity.train(rows, limit=20_000)
    assert not isinstance(small["table"], toxicity.Blocks) and len(large["table"].there) > 4
    words = sorted({w for r in docs.collect() for w in toxicity.words_of(r.text)}) + [b"", b"a", b"zzqq"]
    assert np.allclose(toxicity.word_ratios(words, small["table"]), toxicity.word_ratios(words, large["table"]), atol=1e-6)
    by = {n: (dict(zip(k.tolist(), r.tolist())), dict(zip(h.tolist(), f.tolist()))) for n, (k, r, h, f) in small["table"].items()}
    for w, found in zip(words[::50], toxicity.word_ratios(words[::50], small["table"]), strict=True):
        text, total = b" " + w + b" ", 0.0
        for e in range(2, len(text) + 1):
            for n in range(min(e, 6), 0, -1):
                key = int.from_bytes(text[e - n : e], "big")
                if key in by[n][0] or key >> 8 in by[n][1]:
                    total += by[n][0][key] if key in by[n][0] else by[n][1][key >> 8]
                    break
        assert abs(found - total / (len(w) + 1) ** 0.5) < 1e-6
    want = {r.doc_id: r.score for r in toxicity.predict(docs, small).collect()}
    got = {r.doc_id: r.score for r in toxicity.predict(docs, large).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-6 for k in want)


def test_long_words_are_read_whole(spark, monkeypatch):
    clean, bad = "一二三四五六七八九十" * 12, "毒毒毒毒毒"
    texts = [clean + bad + clean[: k % 7] if k % 2 else clean + clean[: k % 7] for k in range(60)]
    rows = spark.createDataFrame([(k, t, k % 2, k % 3 == 0) for k, t in enumerate(texts)], "doc_id long, text string, toxic int, back boolean")
    model = toxicity.train(rows)
    held = table(spark, [clean * 3, clean * 3 + bad, bad + clean * 2])
    assert [r.predicted for r in toxicity.predict(held, model).orderBy("doc_id").collect()] == [0, 1, 1]
    words = [b"x" * 300 + b"abcdefgh" * 40, b"", b"a", b"word", bytes(range(97, 123)) * 9]
    whole = {n: dict(zip(k.tolist(), c[0].tolist(), strict=True)) for n, k, c in toxicity._grams(words, np.ones((5, 1)))}
    ratios = toxicity.word_ratios(words, model["table"])
    for size in (7, 8, 64, 301):
        monkeypatch.setattr(toxicity, "PART", size)
        parts = {n: {} for n in whole}
        for n, keys, c in toxicity._grams(words, np.ones((5, 1))):
            for k, v in zip(keys.tolist(), c[0].tolist(), strict=True):
                parts[n][k] = parts[n].get(k, 0) + v
        assert parts == whole and np.allclose(toxicity.word_ratios(words, model["table"]), ratios)
    assert sum(whole[1].values()) == sum(len(w) + 1 for w in words)


@pytest.mark.parametrize(("n_toxic", "side"), [(12, False), (12, True), (2, False), (1, False), (1, True)])
def test_toxic_rows_may_all_miss_a_fold(spark, n_toxic, side):
    rng = random.Random(n_toxic)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=30)), 0, k % 5 == 4) for k in range(60)]
    rows += [(100 + k, " ".join([*rng.choices(words, k=15), "zyxwvut", "qzyxwv", *rng.choices(words, k=15)]), 1, side) for k in range(n_toxic)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int, back boolean"))
    held = table(spark, [" ".join(rng.choices(words, k=30)), " ".join([*rng.choices(words, k=30), "zyxwvut", "qzyxwv"])])
    scores = [r.score for r in toxicity.predict(held, model).orderBy("doc_id").collect()]
    assert 0 < scores[0] < scores[1] and (n_toxic < 12 or scores[0] < 0.5 <= scores[1])


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
