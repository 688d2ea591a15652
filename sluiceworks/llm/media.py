"""Media columns: payloads stored losslessly as 8-bit grey PNG images in tar archives, read back by byte range.

Writers put the members of a partition into one archive under the shared folder, with an index of offsets
beside it; the manifest names the archives of the attempts that Spark accepted. The data source plans
byte-range partitions over them, streams record batches, and reads each member again by its offset if it
fails. Null texts count as empty; equal texts are stored as equal bytes; an empty table gives no rows. Null ids are kept, repeated rows are stored
as often as they occur, a very long text is one image, and columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .shared import new_path

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of an archive that one partition reads, and of payload in one record batch.
RANGE, BATCH = 32 << 20, 4 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("n_bytes", "<i8"), ("offset", "<i8"), ("size", "<i8"), ("crc", "<i8")])


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def to_png(payload: bytes) -> bytes:
    """A grey image of UNIT samples a row; its samples are the payload."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)  # each row begins with filter type 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, size, packed = 8, (0, 0), []
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected row filter")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Sixteen sample counts by brightness, then the mean and the deviation."""
    x = np.frombuffer(payload, dtype=np.uint8)
    return ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist())) + f";{x.mean():.3f};{x.std():.3f}"


def write_archives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> str:
    """Store every text as a member of some archive; the folder with the archives, their indexes and manifest."""
    folder = new_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        name, index = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tar", []
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            done = 0
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for i, value in enumerate(batch.column("text")):
                    raw = (value.as_py() or "").encode()
                    media = to_png(padded(raw))
                    info = tarfile.TarInfo(f"{len(index):08d}.png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    out.write(media)
                    out.write(b"\0" * (-len(media) % 512))
                    index.append((ids[i] or 0, ids[i] is not None, len(raw), done + 512, len(media), zlib.crc32(media)))
                    done += 512 + len(media) + -len(media) % 512
            out.write(b"\0" * 1024)
        with fs.open_output_stream(f"{at}/{name}.idx", compression=None) as out:
            out.write(np.array(index, dtype=INDEX).tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "members": [len(index)], "size": [done]})

    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "name string, members long, size long").collect()
    fs, at = FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json", compression=None) as out:
        out.write(json.dumps([r.asDict() for r in made if r["members"]]).encode())
    return folder


class Slice(InputPartition):
    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range = options["path"], int(options.get("rangeBytes", RANGE))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of bytes; a range has the members whose data begins in it."""
        fs, at = FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{at}/manifest.json", compression=None) as f:
            archives = json.loads(f.read())
        return [Slice(x["name"], lo, lo + self.range) for x in archives for lo in range(0, x["size"], self.range)] or [Slice("", 0, 0)]

    def member(self, fs: FileSystem, path: str, row: np.void) -> bytes:
        """One member by its offset, apart from the stream of its range and opened anew on each try."""
        for k in range(self.tries):
            try:
                with fs.open_input_file(path) as f:
                    data = f.read_at(int(row["size"]), int(row["offset"]))
                if zlib.crc32(data) != row["crc"]:
                    raise OSError(f"damaged member at {row['offset']} of {path}")
                return data
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**k)
        raise AssertionError

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, at = FileSystem.from_uri(self.folder)
        path = f"{at}/{partition.archive}"
        if not partition.archive or fs.get_file_info(path).type == FileType.NotFound:
            if partition.archive:
                raise FileNotFoundError(path)
            return
        with fs.open_input_stream(f"{path}.idx", compression=None) as f:
            index = np.frombuffer(f.read(), dtype=INDEX)
        lo, hi = np.searchsorted(index["offset"], [partition.low, partition.high])
        index = index[lo:hi]
        cut = 0
        stream = None
        try:
            while cut < len(index):
                total = np.cumsum(index["size"][cut:])
                end = cut + max(1, int(np.searchsorted(total, BATCH, side="right")))
                rows = index[cut:end]
                stream, block = self.block(fs, path, rows, stream)
                media = [self.sound(fs, path, r, block[int(r["offset"] - rows["offset"][0]) :][: int(r["size"])]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"].copy(), mask=rows["has_id"] == 0), pa.array(rows["n_bytes"].copy()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                cut = end
        finally:
            if stream is not None:
                stream.close()

    def block(self, fs: FileSystem, path: str, rows: np.ndarray, stream):  # noqa: ANN001, ANN201
        """The bytes from the first of these members to the end of the last, from the range's one open stream.

        A failed read gives no bytes and no stream: each member is then read by itself, and the next block opens anew."""
        start, end = int(rows["offset"][0]), int(rows["offset"][-1] + rows["size"][-1])
        try:
            if stream is None:
                stream = fs.open_input_file(path)
            stream.seek(start)
            return stream, memoryview(stream.read(end - start))
        except OSError:
            return None, memoryview(b"")

    def sound(self, fs: FileSystem, path: str, row: np.void, data: memoryview) -> memoryview | bytes:
        """The member as it was streamed, or read again by its offset if that was not whole."""
        return data if len(data) == row["size"] and zlib.crc32(data) == row["crc"] else self.member(fs, path, row)


class ArchiveSource(DataSource):
    """spark.read.format('media_archive').load(folder): doc_id, n_bytes and the stored bytes of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column("media"):
            media = value.as_py()
            payload = from_png(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read it back through the data source, and describe both forms."""
    spark = docs.sparkSession
    folder = write_archives(docs, doc_id, text)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(folder).mapInArrow(digests, OUT)
