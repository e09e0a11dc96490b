"""What filters remove, alone and in every order: counts over the edges of the subset lattice.

A document is described by the set of filters that it fails. An edge of the lattice is a set of
filters already applied and one more that is applied next: with five filters there are 80. Every
document contributes to all of them: it is gone before (it fails one of the set), goes here, or
stays. An order of the filters is a path through the lattice, so its steps (600 for five filters)
take their counts by a join with the edges; no document is looked at twice.

Documents alike in part, failed filters and labels are counted before they contribute, so that
one row for each such kind moves, whatever its number of documents. Copies are found by a digest
of the whole text: rows of a text combine on the map side and no group of copies gathers in a task.

Defined results: a null text is empty, a null language the empty part, a null id is neither
smaller nor larger than another (such a row is no copy, and no row is a copy of it); rows of one
id and text are not copies of each other; a document counts as good (toxic) if any of its labels
says so, without label it is neither; an empty table gives no rows; further columns are not read.
Very long texts are read whole.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import small_or_shuffled

#: The filters of ``failures`` in the order of their bits, and that of copies, which needs the whole table.
OF_TEXT, COPIES = "ABCD", "E"
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The filters of a text that it fails, as bits: A short, B repetitive, C capitals, D symbols."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        F.when(F.size(words) < 200, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 2).otherwise(0)
        + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def described(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, good, toxic, n``: how many documents of a part fail just these filters, by their labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("digest", "doc_id", "part", "fails").agg(F.count("*").alias("n"))
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(small_or_shuffled(own), "doc_id", "left").fillna(False, ["good", "toxic"])
    known = F.col("doc_id").isNotNull()
    kinds = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
    )
    # of a text: one row for each part and labels it comes with
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("own", F.col("unknown") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct("fails", F.col("own").alias("n")), F.struct((F.col("fails") + (1 << len(OF_TEXT))).alias("fails"), (F.col("n") - F.col("own")).alias("n"))))
    return kinds.select("part", "good", "toxic", both.alias("k")).where("k.n > 0").groupBy("part", "k.fails", "good", "toxic").agg(F.sum("k.n").alias("n"))


def lattice_edges(kinds: DataFrame, filters: int) -> DataFrame:
    """``part, applied, next`` (bits) and counts of each edge, from ``kinds(part, fails, good, toxic, n)``."""
    edges = [
        F.struct(F.lit(sum(1 << i for i in done)).alias("applied"), F.lit(1 << f).alias("next"))
        for f in range(filters)
        for size in range(filters)
        for done in combinations([i for i in range(filters) if i != f], size)
    ]
    rows = kinds.withColumn("e", F.explode(F.array(*edges))).select("part", "fails", "good", "toxic", "n", "e.applied", "e.next")
    there, fails = F.col("fails").bitwiseAND(F.col("applied")) == 0, F.col("fails").bitwiseAND(F.col("next")) != 0

    def counted(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return rows.groupBy("part", "applied", "next").agg(
        counted(there & ~fails, "kept"),
        counted(there & fails, "removed"),
        counted(~there & fails, "redundant"),
        counted(F.col("fails") == F.col("next"), "unique_fails"),
        counted(there & fails & F.col("good"), "good_lost"),
        counted(there & fails & F.col("toxic"), "toxic_lost"),
    )


def orders(edges: DataFrame, names: str) -> DataFrame:
    """Each step of each order of the filters, joined with its edge; ``shapley``: what its filter removes, over all orders."""
    bit = {c: 1 << i for i, c in enumerate(names)}
    steps = [("".join(p), k + 1, sum(bit[c] for c in p[:k]), bit[p[k]]) for p in permutations(names) for k in range(len(p))]
    steps = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    # an edge lies on as many paths as its set and the rest have orders
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), F.bit_count("applied") + 1)
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "next")))
    return edges.join(F.broadcast(steps), ["applied", "next"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of ``failures`` and copies, audited in all 120 orders, for each language."""
    return orders(lattice_edges(described(docs, labels), len(OF_TEXT + COPIES)), OF_TEXT + COPIES)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (
  SELECT part, doc_id,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic
  FROM w),
fails AS (SELECT part, good, toxic, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS x,
    concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE l2.c <> l1.c AND l3.c NOT IN (l1.c, l2.c) AND l4.c NOT IN (l1.c, l2.c, l3.c) AND l5.c NOT IN (l1.c, l2.c, l3.c, l4.c)),
s AS (SELECT filter_order, step, filter_order[1:step - 1] AS done, filter_order[step] AS next FROM p, (SELECT unnest(range(1, 6)) AS step)),
steps AS (
  SELECT part, filter_order, step, next,
    count(*) FILTER (gone = 0 AND NOT here) AS kept, count(*) FILTER (gone = 0 AND here) AS removed,
    count(*) FILTER (gone > 0 AND here) AS redundant, count(*) FILTER (failed = next) AS unique_fails,
    count(*) FILTER (gone = 0 AND here AND good) AS good_lost, count(*) FILTER (gone = 0 AND here AND toxic) AS toxic_lost
  FROM (SELECT part, good, toxic, failed, filter_order, step, next, contains(failed, next) AS here, length(failed) - length(translate(failed, done, '')) AS gone FROM fails, s)
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, next) AS BIGINT) AS shapley
FROM steps
"""
