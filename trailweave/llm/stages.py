"""Stages of the corpus pipeline: operators of this folder put to work on ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last
return its columns. Null texts: language identification rejects them. Empty tables give empty
tables; repeated rows stay until near-duplicate removal, which keeps one row of an
id and text (texts of the same shingles count as the same). Very long texts are read whole; of
near duplicates the smallest id stays; columns of any name come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trailweave.llm.common import binary_list, materialize, slices, small_or_shuffled


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters or far from every centroid go."""
    from trailweave.llm.language import predict, train

    model = train(docs)
    told = predict(docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns]), model, text="_text")
    return told.where(~F.col("rejected")).select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def _with_sets(docs: DataFrame, k: int, name: str) -> DataFrame:
    """``docs`` with a hash of the shingle set of ``text`` as column ``name``."""
    import pyarrow as pa
    import xxhash

    from trailweave.llm.neardup import shingle_set

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = binary_list(part.column(part.schema.get_field_index("text")))
                sets = pa.array([xxhash.xxh3_128_hexdigest(shingle_set(t, k).tobytes()) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, sets], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8).

    Rows that share an id are one document only where they share their set, too.
    """
    from trailweave.llm.neardup import near_duplicates

    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))
    of_set, node, row = f"{free}set", f"{free}node", f"{free}row"  # no column has so many underscores
    there = docs.where("doc_id is not null")
    repeated = materialize(there.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        found = materialize(near_duplicates(docs, k=5, percent=80), "neardup")
        dropped = found.where(~F.col("kept")).select("doc_id").distinct()
        return docs.join(small_or_shuffled(dropped), "doc_id", "left_anti").select(docs.columns)
    repeated = small_or_shuffled(repeated)
    once = there.join(repeated, "doc_id", "left_anti").select(docs.columns).withColumn(of_set, F.lit(""))
    rows = once.unionByName(_with_sets(there.join(repeated, "doc_id", "left_semi").select(docs.columns), 5, of_set))
    pairs = rows.select("doc_id", of_set).distinct()
    # numbers in the order of the ids, so that the smallest of a group has the smallest id
    numbered = pairs.orderBy("doc_id", of_set).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    nodes = materialize(spark.createDataFrame(numbered, StructType([*pairs.schema.fields, StructField(node, LongType())])), "nodes")
    rows = materialize(rows.join(small_or_shuffled(nodes), ["doc_id", of_set]), "noded")
    found = materialize(near_duplicates(rows, k=5, percent=80, doc_id=node), "neardup")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(node)).distinct()
    kept = rows.join(small_or_shuffled(dropped), node, "left_anti")
    first = Window.partitionBy(node).orderBy("text", *[F.xxhash64(c) for c in docs.columns])
    one = kept.where(F.col(of_set) != "").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    out = kept.where(F.col(of_set) == "").select(docs.columns).unionByName(one.select(docs.columns))
    return out.unionByName(docs.where("doc_id is null"))


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    from trailweave.llm.decontaminate import decontaminated

    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in ``text`` replaced by placeholders and ``n_chars`` renewed."""
    from trailweave.llm.personal import redacted

    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, decoded`` of all documents."""
    from trailweave.llm.pieces import decode, encode, model_path

    ids = encode(docs, model_path())
    return decode(ids, model_path()).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded")
