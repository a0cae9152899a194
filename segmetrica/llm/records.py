"""Length-delimited binary record files with masked checksums and a separate offset index.

A data file is a run of records; a record is

    length (8 bytes) | masked CRC-32 of those 8 bytes (4) | payload | masked CRC-32 of the payload (4)

all little-endian. A checksum c is masked as rotate_right(c, 15) + 0xA282EAD8 modulo 2**32, so that a record may itself
hold checksums. The payload is the document's id (8 bytes), the width of an id (1 byte: 2, or 4 where the vocabulary needs
it), and the token ids. All records of a file have one width. Beside every data
file lies an index file: the byte offset of each record (8 bytes each) and, last, the file's length, so any record can
be read on its own in any order.

Files are written by the tasks of a job whose rows are range-partitioned by document, into a folder that executors
share; a task attempt writes under a name of its own and renames at the end, so a repeated attempt does no harm. The
list of files is a small table, one row a file. Nothing passes through the driver but file sizes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rawtext import slices
from .shared import materialize, scratch_path
from .units import SLICE, binary, encoder, library, with_end

FILE_BYTES = 64 << 20
FLUSH_BYTES = 4 << 20
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_FRAME_BYTES = 12 + 9 + 4  # length and checksum, doc_id and width, checksum


class DamagedRecord(ValueError):
    """A length or a payload doesn't agree with its checksum."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _TAIL.pack(masked(size)), payload, _TAIL.pack(masked(payload))))


def unframe(data, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at a position, and the position after it."""
    view = memoryview(data)
    if at + _HEAD.size > len(view):
        raise DamagedRecord(f"no whole header at {at}")
    size, check = _HEAD.unpack_from(view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise DamagedRecord(f"the length at {at} is damaged")
    end = at + _HEAD.size + size
    if end + _TAIL.size > len(view):
        raise DamagedRecord(f"the record at {at} is cut off")
    payload = view[at + _HEAD.size : end]
    if masked(bytes(payload)) != _TAIL.unpack_from(view, end)[0]:
        raise DamagedRecord(f"the payload at {at} is damaged")
    return payload, end + _TAIL.size


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _rename(store, base: str, old: str, new: str) -> None:
    store.move(f"{base}/{old}", f"{base}/{new}")


_FILES = "shard long, name string, records long, ids long, bytes long"


def write_records(rows: DataFrame, folder: str, width: int = 4) -> DataFrame:
    """Writes (doc_id, ids: little-endian ids of ``width`` bytes as binary), sorted within its partitions, as record files.

    Every partition starts its own files and begins a new one after about ``FILE_BYTES``. Returns the list of files,
    (shard, name, records, ids, bytes), as a table. An empty partition writes no file.
    """
    spark = rows.sparkSession

    def write(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, tag = context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex}"
        out, offsets, ids, made, waiting, held = None, [], 0, 0, [], 0

        def close():
            nonlocal out, offsets, ids, made
            out.write(b"".join(waiting))
            out.close()
            with store.open_output_stream(f"{base}/{tag}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            name = f"part-{part:05d}-{made:05d}-{tag}"
            _rename(store, base, f"{tag}.idx", f"{name}.idx")
            _rename(store, base, f"{tag}.bin", f"{name}.bin")
            row = pa.RecordBatch.from_pylist(
                [{"shard": part << 32 | made, "name": name, "records": len(offsets) - 1, "ids": ids, "bytes": offsets[-1]}],
                schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]),
            )
            out, offsets, ids, made = None, [], 0, made + 1
            waiting.clear()
            return row

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out, offsets, held = store.open_output_stream(f"{base}/{tag}.bin"), [0], 0
                body = body.as_buffer().to_pybytes() if body.is_valid else b""
                waiting.append(frame(struct.pack("<qB", doc, width) + body))
                offsets.append(offsets[-1] + len(waiting[-1]))
                ids += len(body) // width
                held += len(waiting[-1])
                if held > FLUSH_BYTES:
                    out.write(b"".join(waiting))
                    waiting.clear()
                    held = 0
                if offsets[-1] >= FILE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return materialize(rows.select("doc_id", "ids").mapInArrow(write, _FILES), "record-files")


def read_records(files: DataFrame, folder: str, shuffle_seed: int | None = None) -> DataFrame:
    """Rows (shard, position, before, doc_id, width, ids) of all listed files, every checksum proved.

    ``before`` counts the ids that stand earlier in the same file, which the index gives, and those of the column
    ``base`` of the list, if it has one. Records are found through the
    index and read in blocks of neighbours; with ``shuffle_seed`` they come one by one in an order drawn from the seed.
    A damaged file raises ``DamagedRecord``.
    """

    def read(batches):
        store, base = _store(folder)
        for batch in batches:
            for shard, name, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{base}/{name}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with store.open_input_file(f"{base}/{name}.bin") as f:
                    for block in _blocks(offsets, len(offsets) - 1, shuffle_seed, shard):
                        lo = int(offsets[block[0]])
                        data = f.read_at(int(offsets[block[-1] + 1]) - lo, lo)
                        at, docs, bodies = 0, [], []
                        for _ in block:
                            payload, at = unframe(data, at)
                            doc, width = struct.unpack_from("<qB", payload)
                            docs.append(doc)
                            bodies.append(bytes(payload[9:]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([shard] * len(docs), pa.int64()), pa.array(block, pa.int64()),
                                pa.array((offsets[block] - block * _FRAME_BYTES) // width + earlier, pa.int64()),
                                pa.array(docs, pa.int64()), pa.array([width] * len(docs), pa.int32()), pa.array(bodies, pa.binary()),
                            ],
                            names=["shard", "position", "before", "doc_id", "width", "ids"],
                        )

    # as many tasks as files, each named outright, since the rows are too small for Spark to keep them apart
    base = F.col("base") if "base" in files.columns else F.lit(0)
    listed = files.select("shard", "name", base.cast("long").alias("base")).repartition(max(1, files.count()))
    return listed.mapInArrow(read, "shard long, position long, before long, doc_id long, width int, ids binary")


def _blocks(offsets: np.ndarray, n: int, seed: int | None, shard: int):
    if seed is not None:
        yield from np.random.default_rng([seed, shard]).permutation(n)[:, None]
        return
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + FLUSH_BYTES, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield np.arange(start, stop)
        start = stop


def encode(docs: DataFrame, tokenizer: str, end_id: int, width: int = 4, spaces_count: bool = True) -> DataFrame:
    """(doc_id, ids): the whole text's ids and the end id, ``width`` bytes each. A null text is empty."""

    def run(batches):
        enc = encoder(tokenizer, spaces_count, f"<u{width}")
        for part, strings in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0), binary(*with_end(*enc(strings), end_id))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def export(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encodes documents and writes them as record files in ascending doc_id order: (list of files, folder).

    The order is made by range-partitioning the documents by id before they are encoded, so each text is moved once and
    encoded once. Ids take two bytes where the vocabulary allows. Rows without doc_id have no place and are left out. Repeated ids keep their rows side by side (ordered by text). Empty tables give no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    width = 2 if max(library(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    return write_records(encode(ordered, tokenizer, end_id, width), folder, width), folder


def token_layout(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from record files; start counts the ids of all documents before."""

    def measure(batches):
        for batch in batches:
            wide = [np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4") for w, x in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array([len(x) for x in wide], pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    # one row a file; what stands before a file goes along with its name, so no table of documents is joined
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    return read_records(based, folder).select("before", "doc_id", "width", "ids").mapInArrow(
        measure, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
