"""Token-id output in a bit-plane shuffled binary format.

Texts become ids by encoder.py. Ids, with END after each document, are packed in ascending doc_id order into self-contained shard images of about SHARD ids:
header, document index, chunk index, then chunks of CHUNK ids. A chunk is transposed into 32 bit planes or 4 byte planes,
whichever is smaller on the image's first chunk, each plane compressed with zstandard on its own; planes of one value take no bytes.

Image, little-endian: magic 'BPS2', version u32, n_docs u32, n_null u32, n_chunks u32, n_ids u64; per document doc_id i64
(the first n_null have none) and id count u64; per chunk n_ids u32, n_planes u32, then one u32 stored length for each plane
(0: all bits 0; 0xFFFFFFFF: all bits 1); then the planes.

Defined cases: null or empty text is END alone; rows repeated under a doc_id follow each other (ordered by text) and are
written each; null doc_ids come first and read back as null; a document larger than a shard is a shard of its own; an
empty table gives an empty file. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .encoder import encoder_for
from .runtime import scratch_path, shuffle_partitions, small_batches, total_bytes

END, SHARD, CHUNK, LEVEL = 2, 1 << 19, 1 << 16, 3
#: Text for each task of the writer.
TASK = 128 << 20
_HEAD = struct.Struct("<4sIIIIQ")
_ONES = 0xFFFFFFFF
SCHEMA = "part int, seq long, first_doc long, n_docs long, n_ids long, image binary"


def encode_chunk(ids: np.ndarray, widths: tuple[int, ...] = (4, 32)) -> tuple[list[int], list[bytes]]:
    """Stored lengths and bodies of the planes of one chunk: the smaller of bit (32) and byte (4) planes, or the one asked for."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    found = []
    for width in widths:
        bit = width == 32
        planes = np.unpackbits(raw, axis=1, bitorder="little").T if bit else raw.T
        sizes, bodies = [], []
        for p in planes:
            p = np.ascontiguousarray(p)
            if not p.any():
                sizes.append(0)
            elif p.all() and bit:
                sizes.append(_ONES)
            else:
                bodies.append(press.compress((np.packbits(p, bitorder="little") if bit else p).tobytes()))
                sizes.append(len(bodies[-1]))
        found.append((sum(map(len, bodies)), sizes, bodies))
    return min(found, key=lambda x: x[0])[1:]


def decode_chunk(n: int, sizes: list[int], body: memoryview) -> np.ndarray:
    import zstandard

    press, bit = zstandard.ZstdDecompressor(), len(sizes) == 32
    out = np.zeros((len(sizes), n), np.uint8)
    at = 0
    for k, size in enumerate(sizes):
        if size == _ONES and bit:
            out[k] = 1
        elif size:
            plane = np.frombuffer(press.decompress(bytes(body[at : at + size])), np.uint8)
            out[k] = np.unpackbits(plane, count=n, bitorder="little") if bit else plane
            at += size
    raw = np.packbits(out.T, axis=1, bitorder="little") if bit else np.ascontiguousarray(out.T)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def encode_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """Null doc_ids come first."""
    chunks, widths = [], (4, 32)
    for at in range(0, len(ids), CHUNK):
        part = ids[at : at + CHUNK]
        chunks.append((len(part), *encode_chunk(part, widths)))
        widths = (len(chunks[0][1]),)
    out = [_HEAD.pack(b"BPS2", 2, len(doc_ids), sum(d is None for d in doc_ids), len(chunks), len(ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(counts, "<u8").tobytes()]
    out += [struct.pack(f"<II{len(s)}I", n, len(s), *s) for n, s, _ in chunks]
    return b"".join([*out, *(b for _, _, bodies in chunks for b in bodies)])


def decode_image(image: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, id counts and all ids of an image."""
    magic, version, n_docs, n_null, n_chunks, n_ids = _HEAD.unpack_from(image)
    if magic != b"BPS2" or version != 2:
        raise ValueError("not a bit-plane shard image")
    at = _HEAD.size
    doc_ids = pa.array(np.frombuffer(image, "<i8", n_docs, at), mask=np.arange(n_docs) < n_null)
    counts = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    index = []
    for _ in range(n_chunks):
        n, planes = struct.unpack_from("<II", image, at)
        index.append((n, list(struct.unpack_from(f"<{planes}I", image, at + 8))))
        at += 8 + 4 * planes
    body, parts = memoryview(image), []
    for n, sizes in index:
        parts.append(decode_chunk(n, sizes, body[at:]))
        at += sum(s for s in sizes if not (s == _ONES and len(sizes) == 32))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("the image's chunks don't add up")
    return doc_ids, counts, ids


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Writes shard images of docs to path, in ascending doc_id order of (part, seq)."""
    spark = docs.sparkSession
    # the vocabulary is one file of fixed size
    data = spark.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import chunks

        encoder, seq, held = encoder_for(data.value), 0, []
        end = np.array([END], encoder.kind)

        def image() -> pa.RecordBatch:
            ids = np.concatenate([x for h in held for x in (h[1], end)])
            row = [held[0][2], seq, held[0][0], len(held), len(ids), encode_image([h[0] for h in held], [len(h[1]) + 1 for h in held], ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "first_doc", "n_docs", "n_ids", "image"])

        size = 0
        for batch in chunks(batches, "text"):
            every, counts = encoder([t or b"" for t in batch["text"].cast(pa.large_binary()).to_pylist()])
            for doc, part, ids in zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist(), np.split(every, np.cumsum(counts)[:-1]), strict=True):
                n = len(ids) + 1
                if held and size + n > SHARD:
                    yield image()
                    held, size, seq = [], 0, seq + 1
                held.append((doc, ids, part))
                size += n
        if held:
            yield image()

    # tasks hold about TASK bytes of text at any input size
    n = max(shuffle_partitions(spark), -(-total_bytes(docs) // TASK))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    with small_batches(spark):
        ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    within = W.partitionBy("part").orderBy("seq")
    sizes = shards.select("part", "seq", "n_ids").withColumn("local", F.sum("n_ids").over(within) - F.col("n_ids"))
    # one row for each range partition of the writer
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("base"))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("local") + F.col("base")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["image"].to_pylist(), strict=True):
                doc_ids, counts, ids = decode_image(image)
                edge = np.concatenate(([0], np.cumsum(counts)))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()), doc_ids, pa.array(edge[:-1]), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    read_ = shards.select("part", "seq", "image").mapInArrow(run, "part int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read_.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, vocabulary, path)
    return read(docs.sparkSession, path)
