"""What several operators of this subpackage share: tables, the shared folder, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows of an Arrow batch, and of them those held as Python objects at a time.
BATCH, SLICE = 2000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only on a single machine, as in tests, a folder of this session's own takes its place where the setting is absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, gives Spark real sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs`` alone, whatever their names."""
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``__rid`` that tells its rows apart, in a written table, so that it stays the same."""
    return written(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, gone: DataFrame, limit: int) -> DataFrame:
    """The numbered rows whose number is not in ``gone``: broadcast up to ``limit`` of them, else shuffled."""
    few = gone.count() <= limit
    return rows.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), "__rid", "left_anti").drop("__rid")


def small_batches(df: DataFrame) -> DataFrame:
    """Let Python workers get ``BATCH`` rows at a time where the session has Spark's default of 10,000.

    Both ends of the pipe hold a batch whole, and texts can be long.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH))
    return df


def handing_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches, whose memory goes back to the system when they are done.

    Arrow's pool keeps it otherwise, and so does a worker for as long as it waits for other tasks.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(tidy(batches))
        pa.default_memory_pool().release_unused()

    return run


def with_outputs(docs: DataFrame, text: str, keep: list[str], outputs: dict[str, str], make: Callable[[], Callable]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and new columns computed from the column ``text``, in Arrow batches.

    ``make()`` runs once for each task and gives a function from a list of texts (None for null) to a tuple of lists,
    one for each of ``outputs`` (name -> DDL type). An output replaces a kept column of its name.
    """
    keep = [c for c in keep if c not in outputs]
    row = F.struct(*(F.col(f"`{c}`") for c in keep))
    inside = text in keep
    given = docs.select(row.alias("row"), *([] if inside else [F.col(text).alias("t")]))
    names = list(outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            rows = batch.column("row")
            texts = (rows.field(keep.index(text)) if inside else batch.column("t")).to_pylist()
            got = f(texts)
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(x, types[n]) for n, x in zip(names, got, strict=True))], names=["row", *names])

    out = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in outputs.items()))
    types = {f.name: f.type for f in to_arrow_schema(out)}
    schema = StructType([given.schema["row"], *out.fields])
    return small_batches(given).mapInArrow(handing_back(work), schema).select(*(F.col(f"row.`{c}`") for c in keep), *names)


def held_out(key: str, buckets: int, bucket: int):
    """Whether crc32 of the key as text leaves this remainder; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % buckets == bucket, F.lit(False))


def hash01(key: str):
    """A number in [0, 1) fixed by the key, for samples that do not depend on partitioning."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
