"""Packed token files: round trips, random access, the data source, and the query against the tokenizers library."""

import io
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillmill.llm import bpe, tokenfile as tf


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_packing_round_trip(width):
    draw = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 4096, 5000):
        ids = draw.integers(0, 1 << width, n).astype(np.uint32)
        packed = tf.pack(ids, width)
        assert len(packed) == -(-n * width // 8) and tf.unpack(packed, width, n).tolist() == ids.tolist()


@pytest.mark.parametrize("width", [8, 16, 32])
def test_whole_bytes_are_packed_as_bits_would_be(width, monkeypatch):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003).astype(np.uint32)
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits, bitorder="little").tobytes()
    monkeypatch.delattr(np, "unpackbits")  # no bit has to be taken apart
    assert tf.pack(ids, width) == packed and tf.unpack(packed, width, 1003).tolist() == ids.tolist()


def test_least_width():
    assert [tf.width_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


class Kept(io.BytesIO):
    def close(self):
        pass


def test_file_gives_any_range_and_document():
    draw, out = np.random.default_rng(1), Kept()
    docs = [draw.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 4096, 0, 9000, 1, 3, 12_000)]
    names = [3, None, 5, 5, -7, 1 << 40, 8, 9]
    writer = tf.TokenFileWriter(out, 17)
    writer.add(names[:3], docs[:3])
    writer.add([], [])
    writer.add(names[3:], docs[3:])
    assert writer.close() == (8, sum(map(len, docs)))
    file, flat = tf.TokenFile(pa.BufferReader(out.getvalue())), np.concatenate(docs)
    assert [None if null else int(d) for d, null in zip(file.docs, file.nulls, strict=True)] == names
    assert all((file.document(k) == d).all() for k, d in enumerate(docs))
    pick = random.Random(2)
    for _ in range(50):
        a = pick.randint(0, len(flat))
        n = pick.randint(0, len(flat) - a)
        assert (file.ids(a, n) == flat[a : a + n]).all()
    assert [r for r in file.runs(0, 8)] == [(0, 8)]
    with pytest.raises(IndexError):
        file.ids(len(flat), 1)
    with pytest.raises(ValueError):
        tf.TokenFileWriter(Kept(), 3).add([1], [np.array([8], np.uint32)])


def test_source_keeps_order_nulls_and_empty_tables(spark, tmp_path):
    spark.dataSource.register(tf.PackedIds)
    rows = [(d, None if d % 7 == 0 else [d % 900] * (d % 5)) for d in range(300)] + [(None, [4])]
    spark.createDataFrame(rows, "doc_id long, ids array<int>").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.format("packed_ids").option("width", 10).mode("append").save(f"{tmp_path}/a")
    got = sorted(tf.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda r: r["start"])
    assert len(got) == 301 and {r["doc_id"]: list(r["ids"]) for r in got} == {d: x or [] for d, x in rows}
    before = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        assert r["start"] == before
        before += len(r["ids"])
    spark.createDataFrame([], "doc_id long, ids array<int>").write.format("packed_ids").option("width", 10).mode("append").save(f"{tmp_path}/b")
    assert tf.read_tokens(spark, f"{tmp_path}/b").collect() == [] and json.loads((tmp_path / "b" / tf.MANIFEST).read_text())["ids"] == 0
    with pytest.raises(Exception, match="more than 3 bits"):
        spark.createDataFrame([(1, [8])], "doc_id long, ids array<int>").write.format("packed_ids").option("width", 3).mode("append").save(f"{tmp_path}/c")
    assert not (tmp_path / "c" / tf.MANIFEST).exists()


def test_files_equal_the_library(spark, tmp_path):
    given = [(5, "It's  2024!\n\nmore"), (3, None), (4, ""), (1, "<|endoftext|>x"), (None, "last"), (3, "three"), (9, "long words " * 30_000), (2, "été 你好 🙂"), (2, "été 你好 🙂")]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in given], "doc_id int, text string, start int, ids string").repartition(4)
    tf.write_tokens(docs, f"{tmp_path}/t", bpe.TOKENIZER)
    lib = Tokenizer.from_file(bpe.TOKENIZER)
    want = sorted((lib.encode(t or "", add_special_tokens=False).ids + [2], d is None, d or 0) for d, t in given)
    rows = sorted(tf.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert sorted((list(r["ids"]), r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == want
    assert [(r["doc_id"] is None, r["doc_id"] or 0) for r in rows] == sorted((d is None, d or 0) for d, _ in given)
    assert [r["start"] for r in rows] == np.concatenate(([0], np.cumsum([len(r["ids"]) for r in rows])))[:-1].tolist()
    packed = {r["start"]: zlib.crc32(r["ids"]) for r in tf.read_tokens(spark, f"{tmp_path}/t", packed=True).collect()}
    assert packed == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}
    assert tf.manifest(f"{tmp_path}/t")["width"] == 16
