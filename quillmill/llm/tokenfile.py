"""Token ids in files of fixed-width bit packing, as a Spark data source.

``df.write.format("packed_ids").option("width", 16).save(path)`` writes the ids of each row (``doc_id`` long, ``ids``
binary of little-endian 32-bit ids or array<int>) in the order the partitions have them;
``spark.read.format("packed_ids").load(path)`` gives ``doc_id, start, ids``, where ``start`` is the number of ids before
the document in all files. ``TokenFile`` reads any range of one file's ids, or any document, without the rest.

A file holds blocks of ``BLOCK`` ids, each id in ``width`` bits (lowest bit first), each block at a whole byte; then the
block offsets (bytes), the documents' first ids, their doc_ids and a bit for each null one; last a fixed footer:

    blocks | n_blocks + 1 uint64 | n_docs + 1 uint64 | n_docs int64 | null bits | footer

A task writes a file of its own under a name that no other attempt has; when all have ended, ``_manifest.json`` names
the files that count, in order, with the ids and documents before each. A lost executor's file is in no manifest, and a
folder without one is not a table yet. Files are reached through Arrow's file systems (local, S3, GCS, HDFS).

Defined cases: null ids are no ids; a null doc_id stays null; repeated doc_ids are documents of their own; an empty
partition leaves no file; an empty table reads back empty; an id that is negative or too wide for ``width`` is an error.
"""

from __future__ import annotations

import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillmill.llm import bpe
from quillmill.llm.common import handing_back, shared_folder, small_batches, table

#: Ids of a block; a multiple of 8, so that every full block ends at a whole byte.
BLOCK = 4096
#: Ids that are unpacked or handed on at a time, where a single document has no more.
CHUNK = 1 << 19
#: Documents that a task reads.
PART_IDS = 16_000_000
MAGIC = b"packedid"
FOOTER = struct.Struct("<8sIIQQQ")  # magic, width, block, ids, documents, where the offsets begin
MANIFEST = "_manifest.json"
END = 2


def width_for(vocabulary: int) -> int:
    """The least bits that tell the ids 0 .. vocabulary - 1 apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(packed: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids, as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 4), np.uint8)
    whole[:, : -(-width // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return whole.view("<u4")[:, 0]


class TokenFileWriter:
    """Writes one file: blocks as they fill, then the offsets; holds a block and some 16 bytes a document."""

    def __init__(self, out, width: int) -> None:
        if not 1 <= width <= 32:
            raise ValueError(f"width {width} is not in 1 .. 32")
        self.out, self.width = out, width
        self.left = np.empty(0, np.uint32)
        self.offsets, self.starts, self.docs, self.nulls = array("Q", [0]), array("Q", [0]), array("q"), array("B")

    def add(self, doc_id: list[int | None], ids: list[np.ndarray]) -> None:
        for d, x in zip(doc_id, ids, strict=True):
            self.docs.append(d or 0)
            self.nulls.append(d is None)
            self.starts.append(self.starts[-1] + len(x))
        new = np.concatenate([self.left, *ids]) if ids else self.left
        if len(new) and int(new.max()) >> self.width:
            raise ValueError(f"id {int(new.max())} takes more than {self.width} bits")
        full = len(new) // BLOCK * BLOCK
        for lo in range(0, full, CHUNK):
            self._write(new[lo : min(lo + CHUNK, full)])
        self.left = new[full:].copy()

    def _write(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.width)
        size, begin = BLOCK * self.width // 8, self.offsets[-1]
        self.offsets.extend(begin + min(size * k, len(packed)) for k in range(1, -(-len(ids) // BLOCK) + 1))
        self.out.write(packed)

    def close(self) -> tuple[int, int]:
        """-> (documents, ids)"""
        if len(self.left):
            self._write(self.left)
        for x, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.docs, "<i8")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(np.packbits(np.array(self.nulls, np.uint8), bitorder="little").tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.width, BLOCK, self.starts[-1], len(self.docs), self.offsets[-1]))
        self.out.close()
        return len(self.docs), self.starts[-1]


class TokenFile:
    """One file, open for random access: ``ids(start, n)``, ``document(k)``, and the documents' ids and starts."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        magic, self.width, self.block, self.n_ids, self.n_docs, index = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no file of packed ids")
        n_blocks = -(-self.n_ids // self.block)
        raw = self._bytes(index, size - FOOTER.size - index)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.docs = np.frombuffer(raw, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.nulls = np.unpackbits(np.frombuffer(raw, np.uint8, -1, at), count=self.n_docs, bitorder="little").astype(bool) if self.n_docs else np.empty(0, bool)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``: the blocks that hold them are read, nothing else."""
        if start < 0 or n < 0 or start + n > self.n_ids:
            raise IndexError(f"{start} + {n} is beyond {self.n_ids} ids")
        if not n:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-(start + n) // self.block)
        packed = self._bytes(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        return unpack(packed, self.width, min(b * self.block, self.n_ids) - a * self.block)[start - a * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))

    def runs(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Documents lo .. hi in runs of about ``CHUNK`` ids at most."""
        while lo < hi:
            end = int(np.searchsorted(self.starts, self.starts[lo] + CHUNK, "right")) - 1
            end = min(max(end, lo + 1), lo + 10_000, hi)
            yield lo, end
            lo = end


def open_file(uri: str) -> TokenFile:
    at, path = fs.FileSystem.from_uri(uri)
    return TokenFile(at.open_input_file(path))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    docs: int = 0
    ids: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, width: int) -> None:
        self.folder, self.width = folder, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        at, folder = fs.FileSystem.from_uri(self.folder)
        writer, name = None, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.ids"
        for batch in iterator:
            doc, ids = batch.column("doc_id").to_pylist(), batch.column("ids")
            if not doc:
                continue
            if writer is None:
                at.create_dir(folder)
                writer = TokenFileWriter(at.open_output_stream(f"{folder}/{name}"), self.width)
            if pa.types.is_list(ids.type):
                rows = [np.array(x.as_py() or [], np.int64) for x in ids]
                if any(len(x) and x.min() < 0 for x in rows):
                    raise ValueError("negative id")
                rows = [x.astype(np.uint32) for x in rows]
            else:
                rows = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.empty(0, np.uint32) for x in ids]
            writer.add(doc, rows)
        return Written(task.partitionId(), None) if writer is None else Written(task.partitionId(), name, *writer.close())

    def commit(self, messages: list) -> None:
        at, folder = fs.FileSystem.from_uri(self.folder)
        files, docs, ids = [], 0, 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part):  # one a task
            files.append({"name": m.name, "docs": m.docs, "ids": m.ids, "docs_before": docs, "ids_before": ids})
            docs, ids = docs + m.docs, ids + m.ids
        at.create_dir(folder)
        with at.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps({"width": self.width, "block": BLOCK, "docs": docs, "ids": ids, "files": files}).encode())
        at.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        at, folder = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None and m.name:
                at.delete_file(f"{folder}/{m.name}")


@dataclass
class Part(InputPartition):
    name: str
    ids_before: int
    part: int
    parts: int


def manifest(folder: str) -> dict:
    at, path = fs.FileSystem.from_uri(folder)
    with at.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.packed = folder, schema["ids"].dataType.simpleString() == "binary"

    def partitions(self) -> list[Part]:
        files = manifest(self.folder)["files"]
        return [Part(f["name"], f["ids_before"], k, n) for f in files for n in [f["ids"] // PART_IDS + 1] for k in range(n)] or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        file = open_file(f"{self.folder}/{partition.name}")
        lo, hi = (file.n_docs * k // partition.parts for k in (partition.part, partition.part + 1))
        for a, b in file.runs(lo, hi):
            ends = file.starts[a : b + 1]
            ids, ends, at = file.ids(int(ends[0]), int(ends[-1] - ends[0])), ends - ends[0], ends[:-1] + partition.ids_before
            if self.packed:
                column = pa.array([ids[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            else:
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            doc = pa.array(file.docs[a:b], pa.int64(), mask=file.nulls[a:b])
            yield pa.RecordBatch.from_arrays([doc, pa.array(at, pa.int64()), column], names=["doc_id", "start", "ids"])


class PackedIds(DataSource):
    """Format ``packed_ids``; options ``path``, and ``width`` for writing. Reading with a schema in which ``ids`` is binary gives little-endian 32-bit ids."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, ids array<int>"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].rstrip("/"), int(self.options.get("width", 32)))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), schema)


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """-> doc_id, t: the documents range-partitioned and sorted by id, null last; rows of one id spread over partitions like others."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("r"))
    order = [F.asc_nulls_last("doc_id"), F.asc("r")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")


def encoded(rows: DataFrame, tokenizer: str, end: int | None = END) -> DataFrame:
    """doc_id, t -> doc_id, ids: the ids of each text and ``end``, as little-endian 32-bit numbers.

    What a worker remembers of one task's texts serves its next ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, tail = bpe.load(tokenizer), b"" if end is None else end.to_bytes(4, "little")
        for whole in batches:
            for batch in bpe.few_chars(whole, "t"):
                runs = tables.encode_all(batch.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype("<i4").tobytes() + tail for x in runs], pa.binary())], names=["doc_id", "ids"])

    return small_batches(rows).mapInArrow(handing_back(work), "doc_id long, ids binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end``, and write files of packed ids in ascending order of ``key``."""
    spark = docs.sparkSession
    spark.dataSource.register(PackedIds)
    width = width_for(len(bpe.load(tokenizer).decimal))
    encoded(in_order(docs, key, text), tokenizer, end).write.format("packed_ids").option("width", width).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """-> doc_id, start, ids: array<int>, or ``packed`` for little-endian 32-bit numbers in a binary."""
    spark.dataSource.register(PackedIds)
    reader = spark.read.format("packed_ids")
    return (reader.schema("doc_id long, start long, ids binary") if packed else reader).load(path)


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, bpe.TOKENIZER)
    return read_tokens(spark, path, packed=True).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
