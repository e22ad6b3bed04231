"""Operator 4: token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame per document (ids as little-endian unsigned integers of 2 or 4 bytes, content checksum on), then a skippable frame with the documents' ids,
then the seek table of the published seekable format: for each frame its compressed size, its content's size and the low 32 bits of the content's XXH64. A reader
fetches the table from the file's end and then only the frames that it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, steps, work_dir
from .packing import END_ID
from .tokens import encoder

# Fixed values of the seekable format.
SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")


class FrameWriter:
    """Writes one file; ``add`` takes the ids of a document."""

    def __init__(self, sink, width: int, level: int = 3):
        self.sink, self.width, self.table, self.ids = sink, width, [], []
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        frame = self.compress(raw)
        self.sink.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = bytes([self.width]) + bytes(x is not None for x in self.ids) + np.array([x or 0 for x in self.ids], "<i8").tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = [*self.table, (len(index) + 8, 0, 0)]
        body = np.array(entries, "<u4").tobytes() + _FOOTER.pack(len(entries), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.sink.close()


class FrameReader:
    """Reads the table of a file (an object with ``size`` and ``read_at``), then documents by their place."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = _FOOTER.unpack(source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        index = source.read_at(int(table[-1, 0]), int(self.at[-2]))[8:]
        self.table, n = table[:-1], n - 1
        self.dtype = np.dtype("<u2" if index[0] == 2 else "<u4")
        self.ids = [x if ok else None for ok, x in zip(index[1 : n + 1], np.frombuffer(index[n + 1 :], "<i8").tolist(), strict=True)]
        self.decompress = zstandard.ZstdDecompressor().decompress

    def read(self, first: int, last: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents at places ``first`` up to ``last``; one read of the file, each frame checked."""
        block = self.source.read_at(int(self.at[last] - self.at[first]), int(self.at[first]))
        for k in range(first, last):
            raw = self.decompress(block[self.at[k] - self.at[first] : self.at[k + 1] - self.at[first]])
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            yield self.ids[k], np.frombuffer(raw, self.dtype)

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        """Only the frames of these documents are fetched and decompressed."""
        wanted = set(wanted)
        for k, x in enumerate(self.ids):
            if x in wanted:
                yield from self.read(k, k + 1)


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, tokens = encoder(tokenizer), None, 0
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"  # of this attempt; the manifest names only files that were finished
        for slice_, data, off in steps(batches, "text"):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = FrameWriter(fs.open_output_stream(f"{root}/{name}", compression=None), 2 if max(len(enc.width), end_id + 1) <= 1 << 16 else 4)
            ids, upto = enc.encode(data, off)
            for doc_id, a, b in zip(slice_["doc_id"].to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                writer.add(doc_id, np.append(ids[a:b], np.uint32(end_id)))
                tokens += b - a + 1
        if writer is not None:
            writer.close()
            known = [x for x in writer.ids if x is not None]
            ends = (min(known), max(known)) if known else (None, None)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (len(writer.ids), tokens, *ends))], ["part", "file", "n_docs", "n_tokens", "least_id", "greatest_id"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write files in ascending doc_id order (null ids first, null texts as empty ones, repeated ids side by side).

    ``folder`` is a URI that executors share. Returns the manifest ``part, file, n_docs, n_tokens, least_id, greatest_id`` (of its ids that aren't null); files that a lost task left are not in it.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(_write(folder, tokenizer, end_id), "part int, file string, n_docs long, n_tokens long, least_id long, greatest_id long"))


def _read(folder: str, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    reader, start = FrameReader(source), row["start"]
                    for lo in range(0, len(reader.ids), step):
                        out = []
                        for doc_id, ids in reader.read(lo, min(lo + step, len(reader.ids))):
                            raw = ids.astype("<u4").tobytes()
                            out.append((doc_id, start, len(ids), zlib.crc32(raw), raw))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start`` (ids of all documents before), ``n_tokens, ids_crc32, ids`` (little-endian unsigned 32-bit) of all documents, one task per file."""
    spark, total, rows = manifest.sparkSession, 0, []
    for part, file, n in manifest.select("part", "file", "n_tokens").orderBy("part").collect():  # one row per file
        rows.append((file, total))
        total += n
    files = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _read_some(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    found = [(i, len(ids), ids.astype("<u4").tobytes()) for i, ids in FrameReader(source).documents(row["wanted"])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_tokens", "ids"])

    return run


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids`` of the documents in ``wanted`` (``doc_id``): only files whose range of ids holds one are opened, and only their frames of these are fetched. Unknown and null
    ids find nothing, repeated ones count once."""
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    held = (F.col("doc_id") >= F.col("least_id")) & (F.col("doc_id") <= F.col("greatest_id"))
    files = ids.join(F.broadcast(manifest.select("file", "least_id", "greatest_id")), held).groupBy("file").agg(F.collect_list("doc_id").alias("wanted"))  # one row per file
    return files.mapInArrow(_read_some(folder), "doc_id long, n_tokens long, ids binary")


def new_folder(spark) -> str:
    """A folder of this application's own; give ``write_token_files`` another one for files that are to stay."""
    return f"{work_dir(spark)}/token_files/{uuid.uuid4().hex}"
