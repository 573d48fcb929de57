"""A table of text vectors that is brought up to date by content: hashed tf-idf, normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.staging import exists, sized, staged

#: Places of a vector, and folders of the table.
DIMS, PARTS = 256, 16


def bucket(token: Column, dims: int = DIMS) -> Column:
    """The place of a token: the first eight hex digits of its MD5."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def term_counts(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """docs(id, content) -> id, place, tf: tokens are runs of ASCII letters, digits and points, in lower case."""
    tokens = F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9.]+"), F.lit(0))
    return docs.select("id", F.explode(tokens).alias("t")).groupBy("id", bucket(F.col("t"), dims).alias("place")).agg(F.count("*").alias("tf"))


def fit_idf(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """-> place, idf: ln((1 + documents) / (1 + documents with it)) + 1 for every place of the vector."""
    counts = term_counts(docs, dims).groupBy("place").agg(F.count("*").alias("df"))
    places = docs.sparkSession.range(dims).select(F.col("id").cast("int").alias("place"))
    n = docs.agg(F.count("*").alias("n"))
    return places.join(counts.hint("shuffle_hash"), "place", "left").crossJoin(F.broadcast(n)).select("place", (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))


def vectorise(docs: DataFrame, idf: DataFrame, dims: int = DIMS) -> DataFrame:
    """docs(id, content) -> id, embedding: weights (1 + ln tf) * idf of length 1; zeros for a text without tokens."""
    weighed = term_counts(docs, dims).join(F.broadcast(idf), "place").select("id", "place", ((1 + F.log("tf")) * F.col("idf")).alias("w"))  # a row a place
    sparse = weighed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0))
    places = F.sequence(F.lit(0), F.lit(dims - 1))
    return docs.select("id").join(sparse.hint("shuffle_hash"), "id", "left").select("id", F.transform(places, value).alias("embedding"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """-> id, hash, embedding"""
    return spark.read.parquet(f"{path}/vectors").drop("part")


def upsert_vectors(docs: DataFrame, path: str, dims: int = DIMS, parts: int = PARTS) -> DataFrame:
    """Bring the table at ``path`` to docs(id, content), one row an id -> id, hash of what was computed: new and changed documents.

    Idf is fitted when the table is made and stays with it, so a vector depends on its own text alone. Vectors lie in
    ``parts`` folders by hash of the id; only folders with a change are written again, each replaced as a whole.
    Documents that are not given stay.
    """
    spark = docs.sparkSession
    if not exists(spark, f"{path}/idf/_SUCCESS"):
        fit_idf(docs, dims).coalesce(1).write.mode("overwrite").parquet(f"{path}/idf")
    idf = spark.read.parquet(f"{path}/idf")
    hashed = docs.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    stored = spark.read.parquet(f"{path}/vectors") if exists(spark, f"{path}/vectors") else None
    if stored is not None:
        hashed = hashed.join(stored.select("id", "hash"), ["id", "hash"], "left_anti")
    changed = staged(hashed, "changed-documents")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    new = vectorise(changed, idf, dims).join(changed.select("id", "hash"), "id").select("id", "hash", "embedding", part.alias("part"))
    if stored is not None:
        touched = [r[0] for r in changed.select(part.alias("part")).distinct().collect()]  # ``parts`` at most
        kept = stored.where(F.col("part").isin(touched)).join(sized(changed.select("id")), "id", "left_anti")
        new = new.unionByName(kept.select(new.columns))
    staged(new, "vectors").repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/vectors")
    return changed.select("id", "hash")
