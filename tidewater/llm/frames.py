"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a run of frames, a directory of its documents in a skippable frame, and the seek table of the published
seekable format in another, with XXH64 checksums of the decompressed frames. Ids lie one after another, `width` bytes each,
little-endian; a document is a range of them, so a long one runs over several frames and a reader decompresses only the frames that
its documents lie in. A folder holds files in order of document and a manifest that is written last, so what failed tasks leave is never read.

The files are a Spark data source: format("token_frames"), registered by write_tokens() and read_tokens().
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewater.llm.common import NULL_ID, real_id, texts
from tidewater.llm.vocab import ship, tokenizer_file
from tidewater.llm.wordids import slices, word_ids

FILE = "word_bpe_49k.json"
#: The id after each document of the query.
END = 2
#: Bytes of ids in a frame.
FRAME = 1 << 18
LEVEL = 3
#: Bytes of ids in an Arrow batch of a reader.
BATCH = 1 << 22

#: Numbers of the seekable format; fixed values.
SKIPPABLE, SEEK_FRAME, SEEKABLE, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "_manifest.json"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


class FrameWriter:
    """Writes documents to one file; holds one frame and the directory."""

    def __init__(self, out, width: int, frame: int = FRAME):
        self.out, self.width, self.frame = out, width, frame
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.held, self.entries = bytearray(), []
        self.ids, self.counts = [], []

    def add(self, doc_id: int, packed: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(packed) // self.width)
        self.held += packed
        if len(self.held) >= self.frame:
            self._flush(len(self.held) - len(self.held) % self.frame)

    def _flush(self, upto: int) -> None:
        for at in range(0, upto, self.frame):
            self._frame(bytes(self.held[at : min(upto, at + self.frame)]))
        del self.held[:upto]

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> int:
        """Writes the directory and the seek table; returns the number of ids."""
        self._flush(len(self.held))
        counts = np.array(self.counts, "<i8")
        head = struct.pack("<IQ", self.width, len(counts))
        frame = _skippable(SKIPPABLE, head + self.packer.compress(np.array(self.ids, "<i8").tobytes() + counts.tobytes()))
        self.out.write(frame)
        entries = [*self.entries, (len(frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries)
        self.out.write(_skippable(SEEK_FRAME, table + struct.pack("<IBI", len(entries), HAS_CHECKSUMS, SEEKABLE)))
        return int(counts.sum())


class FrameFile:
    """Reads one file by its seek table. ``opened`` counts frames that were decompressed."""

    def __init__(self, source):
        self.source, self.opened, self._last = source, 0, (-1, b"")
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9)) if size >= 17 else (0, 0, 0)
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n
        table = np.frombuffer(source.read_at(12 * n, start), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)]).tolist()
        self.begin = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)]).tolist()
        self.sums = table[:, 2].tolist()
        if start != self.at[-1] + 8:
            raise ValueError("the seek table does not fit the file")
        directory = source.read_at(self.at[-1] - self.at[-2], self.at[-2])
        self.width, docs = struct.unpack_from("<IQ", directory, 8)
        # content_size is in the frame; it bounds what is decompressed
        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(directory[20:]), "<i8").reshape(2, docs)
        self.ids, self.counts = found[0], found[1]

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(self.at[k + 1] - self.at[k], self.at[k]), max_output_size=self.begin[k + 1] - self.begin[k])
            if len(raw) != self.begin[k + 1] - self.begin[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not have its checksum")
            self.opened += 1
            self._last = k, raw
        return self._last[1]

    def tokens(self, first: int, n: int) -> bytes:
        """Packed ids first .. first + n - 1 of the file."""
        low, high, out = first * self.width, (first + n) * self.width, []
        k = bisect_right(self.begin, low) - 1
        while low < high:
            raw, base = self.frame(k), self.begin[k]
            out.append(raw[low - base : high - base])
            low, k = max(low, self.begin[k + 1]), k + 1
        return out[0] if len(out) == 1 else b"".join(out)

    def wide(self, first: int, n: int) -> bytes:
        """The same as unsigned 32-bit integers."""
        raw = self.tokens(first, n)
        return raw if self.width == 4 else np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()


@dataclass
class Written(WriterCommitMessage):
    file: str = ""
    part: int = 0
    docs: int = 0
    tokens: int = 0
    first: int = 0
    last: int = 0


@dataclass
class FilePart(InputPartition):
    file: str
    start: int

    def __init__(self, file: str, start: int):
        self.file, self.start, self.value = file, start, file


class _Writer(DataSourceArrowWriter):
    """Two phases: a task writes one file under a name of its own, the driver names the files of tasks that succeeded in the manifest."""

    def __init__(self, path: str, width: int, frame: int):
        self.path, self.width, self.frame = path, width, frame
        store, root = filesystem(path)
        if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds token files already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        writer = out = None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in iterator:
            if batch.num_rows and writer is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = FrameWriter(out, self.width, self.frame)
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(NULL_ID if doc_id is None else doc_id, ids.as_py() or b"")
        if writer is None:
            return Written(part=part)
        tokens = writer.close()
        out.close()
        return Written(name, part, len(writer.ids), tokens, writer.ids[0], writer.ids[-1])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.part):
            files.append({"file": m.file, "docs": m.docs, "tokens": m.tokens, "start": start, "first": m.first, "last": m.last})
            start += m.tokens
        with store.open_output_stream(f"{root}/{MANIFEST}.new", compression=None) as f:
            f.write(json.dumps({"width": self.width, "files": files}).encode())
        store.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{root}/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{root}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[FilePart]:
        store, root = filesystem(self.path)
        with store.open_input_file(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        return [FilePart(x["file"], x["start"]) for x in files]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "start"):
            return
        store, root = filesystem(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as source:
            f = FrameFile(source)
            begin = np.concatenate([[0], np.cumsum(f.counts)])
            step = max(1, BATCH // 4)
            at, n = 0, len(f.counts)
            while at < n:
                end = max(at + 1, int(np.searchsorted(begin, begin[at] + step, "right")) - 1) if self.with_ids else min(n, at + 65_536)
                columns = [pa.array(f.ids[at:end]), pa.array(begin[at:end] + partition.start), pa.array(f.counts[at:end])]
                if self.with_ids:
                    offsets = ((begin[at : end + 1] - begin[at]) * 4).astype(np.int32)
                    data = f.wide(int(begin[at]), int(begin[end] - begin[at]))
                    columns.append(pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]))
                    names = ["doc_id", "start", "n_tokens", "ids"]
                else:
                    columns += [pa.array([partition.file] * (end - at)), pa.array(begin[at:end])]
                    names = ["doc_id", "start", "n_tokens", "file", "at"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = end


class TokenFrames(DataSource):
    """format("token_frames"). Writing takes (doc_id long, ids binary) with option width; reading with option ids false leaves the ids where they are."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def _with_ids(self) -> bool:
        return self.options.get("ids", "true") == "true"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, " + ("ids binary" if self._with_ids() else "file string, at long")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._with_ids())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("width", 4)), int(self.options.get("frame", FRAME)))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, end: int | None = END, frame: int = FRAME) -> None:
    """Writes the token ids of every whole text to path, in ascending order of id, each document followed by the id `end`.

    A null or empty text has only its end; texts of any length are encoded whole and run over as many frames as they need; an added token's string inside a text
    is that token; rows that share an id are written each, side by side in any order; a null id comes first; an empty table
    gives a folder without files; other columns are not read. Rows are dealt to files by quantiles of the ids, and an id that
    fills several is spread over them, so no file depends on one id.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFrames)
    shipped = ship(spark, file or tokenizer_file(FILE))
    width = word_ids(shipped).width
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts(docs, id_col, text_col).select("id", F.monotonically_increasing_id().alias("row"), "text")
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("id", shares, max(10_000, 20 * n)).alias("q")).first()["q"] if shares else None
    bounds = np.array(found or [], np.int64)
    tail = b"" if end is None else int(end).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(shipped)
        for batch in batches:
            for at, size in slices(batch.column(2)):
                part = batch.slice(at, size)
                ids = part.column(0).to_numpy()
                low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
                spread = part.column(1).to_numpy() % (high - low + 1)
                packed = [x + tail for x in encoder.encode(part.column(2))]
                yield pa.RecordBatch.from_arrays([pa.array((low + spread).astype(np.int32)), part.column(0), pa.array(packed, pa.binary())], ["bucket", "id", "ids"])

    dealt = rows.mapInArrow(run, "bucket int, id long, ids binary").repartitionById(n, "bucket").sortWithinPartitions("id")
    dealt.select("id", "ids").write.format("token_frames").mode("append").option("width", width).option("frame", frame).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document, the ids of all documents before it, its own number, and its ids as packed unsigned 32-bit integers (numpy's "<u4")."""
    spark.dataSource.register(TokenFrames)
    return spark.read.format("token_frames").load(path).withColumn("doc_id", real_id("doc_id"))


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents whose ids are wanted; only the frames that they lie in are decompressed.

    Directories are joined with the ids; what is found is dealt by file, and a file is opened once per task that reads from it. Ids that no
    document has give no row; repeated ones give one; null fetches documents without an id.
    """
    spark.dataSource.register(TokenFrames)
    places = spark.read.format("token_frames").option("ids", "false").load(path)
    ids = wanted.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
    found = places.join(ids, "doc_id", "left_semi").repartition("file").sortWithinPartitions("file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        name, f = None, None
        for batch in batches:
            held, size, rows = [], 0, batch.to_pylist()
            for k, x in enumerate(rows):
                if x["file"] != name:
                    name = x["file"]
                    f = FrameFile(store.open_input_file(f"{root}/{name}"))
                held.append((x["doc_id"], x["start"], x["n_tokens"], f.wide(x["at"], x["n_tokens"])))
                size += len(held[-1][3])
                if size >= BATCH or k == len(rows) - 1:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["doc_id", "start", "n_tokens", "ids"])
                    held, size = [], 0

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", real_id("doc_id"))


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files that write_tokens() leaves at path, read back; its docstring says what it does with hostile rows."""
    write_tokens(docs, path, id_col, text_col, file)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
