"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A payload is stored as a grey PNG of 8-bit samples, 576 to a row, in a tar
shard in the shared folder. Rows carry its digest, shard, offset and length. A payload
is stored once: rows whose digest no other row has are written by the task that reads them; the others
meet by digest first. A bitmap of fixed size tells the two apart in one pass. It may send a
single row the longer way, never a repeated one the short way. A shard's name has a part of its
own for each attempt, and only a finished attempt's places are recorded, so a lost executor leaves an unused file at worst.

Metadata (width, height, depth) come from the 33 bytes that begin a member, features from the samples read back.

Defined results: a null text counts as empty and is one row of padding; a null doc_id is carried along;
repeated rows and equal texts share one stored payload; an empty table gives an empty result and no shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, new_path, slices, table, written

WIDTH = 576
#: Bits of the map of repeated digests; its size does not depend on the input.
BITS = 1 << 24
#: A task begins a new shard beyond this size.
SHARD_BYTES = 1 << 30
#: A range of a shard that one task reads.
READ_BYTES = 32 << 20

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """UTF-8 text with bytes 255 up to a positive multiple of the width."""
    return text + b"\xff" * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def payload_column(text: Column) -> Column:
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), F.greatest(F.ceil(n / WIDTH), F.lit(1)).cast("int") * WIDTH - n)))


def to_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), dtype=np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and depth from the first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, *_ = struct.unpack(">IIBBBBB", first[16:29])
    return width, height, depth


def from_png(media: bytes) -> bytes:
    width, height, depth = png_header(media[:33])
    at, data = 33, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8]) if at + 12 <= len(media) else (len(media), b"")
        if at + 12 + n > len(media):
            raise ValueError("cut-off PNG chunk")
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width * depth // 8 + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return rows[:, 1:].tobytes()


def feature(samples: bytes, width: int, height: int) -> str:
    """Size, mean sample, and a 64-bit average hash over 64 equal parts."""
    x = np.frombuffer(samples, dtype=np.uint8)
    parts = x.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(parts * 64 > parts.sum()).tobytes().hex()
    return f"{width}x{height}:{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:{bits}"


class ShardWriter:
    """Tar shards of one task."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.path = FileSystem.from_uri(folder)
        self.stream, self.shard, self.at = None, "", 0

    def put(self, name: str, media: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of what was stored."""
        if self.stream is None or self.at > SHARD_BYTES:
            self.close()
            self.shard = f"{uuid.uuid4().hex}.tar"
            self.stream, self.at = self.fs.open_output_stream(f"{self.path}/{self.shard}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = self.shard, self.at + len(head), len(media)
        self.stream.write(head + media + b"\0" * (-len(media) % 512))
        self.at += len(head) + len(media) + -len(media) % 512
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(b"\0" * 1024)
            self.stream.close()
            self.stream = None


_PLACE = "digest string, shard string, offset long, length long, media binary"
_PLACE_SCHEMA = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("media", pa.binary())])


def _repeated(digests: DataFrame) -> bytes:
    """A compressed bitmap with a bit for each digest that several rows have."""
    place = F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") % BITS
    several = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(place.alias("p"))
    words = several.groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 32 AS INT))")).alias("bits"))
    out = np.zeros(BITS // 32, dtype=np.uint32)
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return zlib.compress(out.tobytes(), 1)


def store(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stores the payload of every row's text.

    Returns rows (doc_id, n_bytes, payload_bytes, digest) and places (digest, shard, offset, length), one for each digest.
    """
    from pyarrow.fs import FileSystem

    spark = docs.sparkSession
    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = payload_column(F.col("text"))
    rows = written(
        named.select(
            "doc_id",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            F.octet_length(whole).cast("long").alias("payload_bytes"),
            F.sha2(whole, 256).alias("digest"),
        ),
        "media_rows",
        "zstd",
    )
    repeated = spark.sparkContext.broadcast(_repeated(rows))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stores single payloads; hands on the others, each once."""
        bits = np.frombuffer(zlib.decompress(repeated.value), dtype=np.uint32)
        writer, met = ShardWriter(folder), set()
        for batch in batches:
            for part in slices(batch, 0):
                out = []
                for text in part.column(0).to_pylist():
                    samples = payload((text or "").encode())
                    digest = hashlib.sha256(samples).hexdigest()
                    p = int(digest[:6], 16) % BITS
                    if not bits[p // 32] >> (p % 32) & 1:
                        out.append((digest, *writer.put(f"{digest}.png", to_png(samples)), None))
                    elif digest not in met:
                        met.add(digest)
                        if len(met) > 100_000:
                            met.clear()
                        out.append((digest, None, None, None, to_png(samples)))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, _PLACE_SCHEMA)], schema=_PLACE_SCHEMA)
        writer.close()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by digest: the first of each is stored."""
        writer, last = ShardWriter(folder), None
        for batch in batches:
            out = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest != last:
                    out.append((digest, *writer.put(f"{digest}.png", media), None))
                last = digest
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, _PLACE_SCHEMA)], schema=_PLACE_SCHEMA)
        writer.close()

    once = written(map_arrow(named.select("text"), first, _PLACE), "media_first", "zstd")
    again = once.filter("media IS NOT NULL").select("digest", "media").repartition("digest").sortWithinPartitions("digest")
    twice = written(map_arrow(again, second, _PLACE), "media_second")
    return rows, once.filter("media IS NULL").unionByName(twice).drop("media")


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """places with width, height, depth (header-only reads) and tail_crc32, media_sha256, feature (whole reads).

    The hash of the payload as read back must be its digest, else the store is damaged and that is an error.
    """
    kept = ["digest", "shard", "offset", "length"]
    schema = pa.schema([
        ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32()),
        ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        opened, name = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if shard != name:
                    if opened is not None:
                        opened.close()
                    opened, name = fs.open_input_file(f"{path}/{shard}"), shard
                width, height, depth = png_header(opened.read_at(33, offset))
                media = opened.read_at(length, offset)
                samples = from_png(media)
                if hashlib.sha256(samples).hexdigest() != digest:
                    raise ValueError(f"{shard} at {offset} does not hold {digest}")
                out.append((
                    digest, shard, offset, length, width, height, depth, zlib.crc32(samples[-32:]), hashlib.sha256(media).hexdigest(), feature(samples, width, height)
                ))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)
        if opened is not None:
            opened.close()

    dealt = places.select(*kept).withColumn("part", F.floor(F.col("offset") / READ_BYTES)).repartition("shard", "part").sortWithinPartitions("shard", "offset")
    return map_arrow(
        dealt.select(*kept), run,
        "digest string, shard string, offset long, length long, width int, height int, depth int, tail_crc32 long, media_sha256 string, feature string",
    )


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row for each row of docs with its place and all media columns."""
    folder = folder or new_path(docs.sparkSession, "media")
    rows, places = store(docs, folder)
    return rows.join(written(read_back(places, folder), "media_columns", "zstd"), "digest")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature",
        "shard", "offset", "width", "height", "depth",
    )
