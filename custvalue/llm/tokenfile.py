"""Files of token ids packed into the fewest bits that the vocabulary needs.

Layout, all integers little-endian:

    blocks   ids in blocks of ``block`` ids; id i of a block is bits
             i * bits .. (i + 1) * bits - 1 of its bytes, least significant first
    index    int64 document ids; uint64 first id of each document and the end;
             uint64 byte offset of each block and the end
    tail     uint32 bits, block; uint64 documents, blocks; 8 bytes ``TOKBITS1``

Blocks stream to the file as they fill and the index follows, so a writer holds
one block. A reader finds the blocks of any document from the index and unpacks
them with numpy.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custvalue.llm.kept import releasing
from custvalue.llm.tokens import encoded
from custvalue.session import ensure_checkpoint_dir, materialise

MAGIC, TAIL = b"TOKBITS1", struct.Struct("<IIQQ8s")


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id under ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    at = np.arange(count, dtype=np.int64) * bits
    word = np.zeros(count, np.uint64)
    for j in range((bits + 14) // 8):
        word |= padded[(at >> 3) + j] << np.uint64(8 * j)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes documents to an open stream, a block at a time."""

    def __init__(self, stream, bits: int, block: int):
        self.stream, self.bits, self.block = stream, bits, block
        self.docs, self.starts, self.offsets = [], [0], [0]
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.waiting)
            full = self.held - self.held % self.block
            for i in range(0, full, self.block):
                self._put(joined[i : i + self.block])
            self.waiting, self.held = [joined[full:]], self.held - full

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.stream.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        self.stream.write(np.array(self.docs, "<i8").tobytes())
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(TAIL.pack(self.bits, self.block, len(self.docs), len(self.offsets) - 1, MAGIC))
        self.stream.close()


class Reader:
    """Random access to the documents of a file opened for random reads."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - TAIL.size)
        self.bits, self.block, docs, blocks, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        file.seek(size - TAIL.size - 8 * (docs + docs + 1 + blocks + 1))
        self.docs = np.frombuffer(file.read(8 * docs), "<i8")
        self.starts = np.frombuffer(file.read(8 * (docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _block(self, n: int) -> np.ndarray:
        if self.held[0] != n:
            count = min(self.block, int(self.starts[-1]) - n * self.block)
            self.file.seek(int(self.offsets[n]))
            data = self.file.read(int(self.offsets[n + 1] - self.offsets[n]))
            self.held = (n, unpack_bits(data, count, self.bits))
        return self.held[1]

    def ids(self, at: int) -> np.ndarray:
        """Ids of the document at a place of the index."""
        a, b = int(self.starts[at]), int(self.starts[at + 1])
        parts = [
            self._block(n)[max(0, a - n * self.block) : b - n * self.block]
            for n in range(a // self.block, -(-b // self.block))
        ]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, "<u4"), *parts])


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or uri."""
    if ":/" not in folder:
        return pafs.LocalFileSystem(), folder
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which the executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(
    df: DataFrame,
    folder: str,
    tokenizer_path: str,
    vocabulary: int,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 65536,
    file_ids: int = 1 << 26,
) -> DataFrame:
    """Write the ids of all texts, each with ``end_id``, in ascending id order; return the files.

    Rows are range-partitioned by id (rows of equal ids keep the order they are
    read in, and may span partitions; null ids come first, as the least integer
    in the files). Each task writes its own files, a new one once ``file_ids``
    ids are in, under a private name that is renamed when complete, so a task
    that runs again replaces its files. Null texts are empty; an empty table
    writes no file. Returns ``path, documents, ids, start`` (ids of all files
    before); it is materialised, so files are written once.
    """
    bits = bits_for(vocabulary)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        part, n, writer, name, done = TaskContext.get().partitionId(), 0, None, "", []

        def finish():
            writer.close()
            system.move(f"{base}/{name}.{own}", f"{base}/{name}")
            done.append((part, n, f"{base}/{name}", len(writer.docs), writer.starts[-1]))

        own = f"{uuid.uuid4().hex}.tmp"
        for doc, ids in encoded(batches, tokenizer_path, end_id):
            if writer is None:
                name = f"part-{part:06d}-{n:05d}.tok"
                writer = Writer(system.open_output_stream(f"{base}/{name}.{own}"), bits, block)
            writer.add(-(2**63) if doc is None else doc, ids)
            if writer.starts[-1] >= file_ids:
                finish()
                writer, n = None, n + 1
        if writer is not None:
            finish()
        for row in done:
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "n", "path", "documents", "ids"), ([x] for x in row))))

    rows = df.select(
        df[id_col].cast("long").alias("id"), df[text_col].alias("text"), F.monotonically_increasing_id().alias("_at")
    )
    rows = rows.repartitionByRange("id", "_at").sortWithinPartitions("id", "_at")
    files = rows.select("id", "text").mapInArrow(releasing(save), "part long, n long, path string, documents long, ids long")
    files = materialise(files)
    before = Window.orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("path", "documents", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def read(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (binary)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for file in batch.to_pylist():
                with system.open_input_file(file["path"]) as stream:
                    reader = Reader(stream)
                    for first in range(0, len(reader.docs), 2000):
                        at = range(first, min(first + 2000, len(reader.docs)))
                        ids = [reader.ids(i).tobytes() for i in at]
                        docs = reader.docs[first : first + 2000]
                        starts = file["start"] + reader.starts[first : first + len(at)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(docs, pa.int64(), mask=docs == -(2**63)),
                                "start": pa.array(starts, pa.int64()),
                                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                                "ids": pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                            }
                        )

    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return spread.select("path", "start").mapInArrow(releasing(load), schema)
