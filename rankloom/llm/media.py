"""Media columns: payloads stored as lossless 8-bit images in archives, read by a data source of byte ranges.

`write_archives` turns each payload into an 8-bit grey image 64 samples wide (PNG, so deflated and
lossless) and streams the images of a partition into zip archives of about `archive_bytes` in a folder of
the shared store. Archives get their final names by a rename once they are whole, and the names follow
from the partition's number, so a task that runs again (a lost executor, speculation) replaces its own
archives and leaves no second copy.

`MediaArchives` is the Spark data source ("media_archives") that reads such a folder. The driver lists
the archives and plans byte ranges; a task reads the members whose headers lie in its range, in batches
bounded in bytes, and checks each member by its CRC. A member that can't be read is tried again by its
own offset on a newly opened file, `retries` times, without touching the others; after that the read
fails, or with onerror = "null" the member comes back with null columns and its error.

Paths are URIs of any file system that pyarrow knows (file, hdfs, s3, gs); plain paths are local ones.

Defined results: a null or empty payload is one row of 64 zero bytes; a null doc_id comes back null; a
payload of any length is one member, held whole while it is written or read; repeated rows and ties are
stored each; extra columns are left out, whatever they are called; an empty folder or table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, small_batches

WIDTH = 64
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, feature string, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(data: bytes, level: int = 1) -> bytes:
    """A grey PNG of the padded bytes, each row unfiltered; the unpadded length is in a text chunk."""
    samples = np.frombuffer(padded(data), dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)  # each row begins with its filter, 0
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    length = b"Length\0%d" % len(data)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", length) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of such an image."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image of this kind")
    at, height, n, packed = 8, 0, 0, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("an image chunk is damaged")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not of this kind")
    return rows[:, 1:].tobytes(), n


def describe(payload: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = p @ np.arange(256)
    spread = np.sqrt(p @ (np.arange(256) - mean) ** 2)
    some = p[p > 0]
    return f"h={len(payload) // WIDTH};mean={mean:.4f};sd={spread:.4f};entropy={-(some * np.log2(some)).sum():.4f}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):  # Hadoop writes file:/x as well as file:///x
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> int:
    """Stores docs(doc_id, payload binary) in archives under the folder; the number of archives."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part, number, archive, sink, place = TaskContext.get().partitionId(), 0, None, None, ""

        def close() -> None:
            nonlocal archive, number
            archive.close()
            sink.close()
            final = f"{root}/part-{part:05d}-{number:04d}.zip"
            if fs.get_file_info(final).type != pafs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(place, final)
            archive, number = None, number + 1

        done = 0
        for batch in batches:
            for i, (doc_id, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if archive is None:
                    place = f"{root}/_{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(place)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{done + i:09d}_{'' if doc_id is None else doc_id}.png"), to_image(data.as_py() or b""))
                if archive.start_dir >= archive_bytes:
                    close()
            done += batch.num_rows
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["n"])

    return small_batches(docs).select("doc_id", "payload").mapInArrow(store, "n long").agg(F.sum("n").alias("n")).first().n or 0


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class MediaArchives(DataSource):
    """Options: path; range_bytes (16 MB); batch_bytes (8 MB); retries (3); onerror (fail or null)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.retries = int(options.get("retries", 3))
        self.null_on_error = options.get("onerror", "fail") == "null"

    def partitions(self) -> list[Range]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        archives = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip"))
        ranges = [Range(p, at, min(at + self.range_bytes, size)) for p, size in archives for at in range(0, size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            members = [(m.header_offset, m.filename, m.file_size, m.CRC) for m in archive.infolist() if partition.begin <= m.header_offset < partition.end]
        rows, held, file = [], 0, fs.open_input_file(partition.path)
        for offset, name, size, crc in sorted(members):
            file, row = self.member(fs, partition.path, file, offset, name, size, crc)
            rows.append(row)
            held += size + len(row[2] or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        file.close()
        if rows:
            yield _batch(rows)

    def member(self, fs, path: str, file, offset: int, name: str, size: int, crc: int):  # noqa: ANN001, ANN201
        """One member by its offset; the file is opened anew for each further try."""
        doc_id = name.removesuffix(".png").partition("_")[2]
        doc_id = int(doc_id) if doc_id else None
        for left in reversed(range(self.retries + 1)):
            try:
                head = file.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member begins here")
                skip = 30 + sum(struct.unpack("<HH", head[26:30]))
                media = file.read_at(size, offset + skip)
                if len(media) != size or zlib.crc32(media) != crc:
                    raise ValueError("the member is damaged")
                payload, n = from_image(media)
                return file, (doc_id, n, payload, media, describe(payload), None)
            except Exception as e:  # a store may fail in any way; the last try decides
                if not left:
                    if not self.null_on_error:
                        raise OSError(f"{path}, member at {offset}: {e}") from e
                    return file, (doc_id, None, None, None, None, f"{path}@{offset}: {e}")
                file = fs.open_input_file(path)
        raise AssertionError


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "payload", "media", "feature", "error"])


def read_archives(spark: SparkSession, folder: str, **options: str | int) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # registering it again is fine
        spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "media")
    write_archives(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload")), folder)
    stored = read_archives(spark, folder)
    return stored.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
