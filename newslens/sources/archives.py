"""Zipped feed files, read in place."""

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from newslens.schemas import RAW_EVENT, RAW_GKG
from newslens.sources.delimited import parsed_lines

# Endings of the archive members that hold rows.
MEMBER_ENDINGS = (".CSV", ".csv", ".txt")
# Characters of the lines that go on together, whatever their number.
CHARS_PER_BATCH = 2 << 20


# Archives beyond it are dealt out member by member.
LARGE_ARCHIVE = 64 << 20


def _line_batch(lines):
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])


def _lines_of(member):
    """Batches of the lines of an open member, which is streamed and not held whole."""
    text = io.TextIOWrapper(member, encoding="utf-8", errors="replace")
    while lines := text.readlines(CHARS_PER_BATCH):
        yield _line_batch(lines)


def _row_members(archive):
    return [m for m in archive.infolist() if "/" not in m.filename and m.filename.endswith(MEMBER_ENDINGS)]


def _member_lines(batches):
    """(content) batches -> batches of text lines."""
    for batch in batches:
        for content in batch.column("content"):
            # Read where the batch holds it, without a copy.
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                for info in _row_members(archive):
                    with archive.open(info) as member:
                        yield from _lines_of(member)


def _packed_members(batches):
    """(path, content) batches -> a row per member, as an archive of that member alone.

    Members keep their compressed bytes: they are cut out by the archive's directory and nothing
    is decompressed here.
    """
    names = ["path", "member", "method", "packed_bytes", "crc", "n_bytes"]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            view = memoryview(content.as_buffer())
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                for info in _row_members(archive):
                    # The local header ends in a name and an extra field of its own lengths.
                    at = info.header_offset
                    lengths = (int.from_bytes(view[at + i : at + i + 2], "little") for i in (26, 28))
                    start = at + 30 + sum(lengths)
                    packed = bytes(view[start : start + info.compress_size])
                    row = [[path.as_py()], [info.filename], [info.compress_type], [packed], [info.CRC], [info.file_size]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(row, (
                            pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names,
                    )


class _Inflated(io.RawIOBase):
    """Member bytes, decompressed as they are read; a wrong length or checksum is an error."""

    def __init__(self, method, packed, crc, n_bytes):
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"zip method {method} is not supported for members dealt out singly")
        self.packed, self.at, self.want = memoryview(packed), 0, (n_bytes, crc)
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self.seen, self.crc, self.rest = 0, 0, b""

    def readable(self):
        return True

    def readinto(self, out):
        data = b""
        while not data and (self.at < len(self.packed) or self.rest):
            piece = self.rest or self.packed[self.at : self.at + (1 << 20)]
            if not self.rest:
                self.at += len(piece)
            if self.inflate is None:
                data, self.rest = bytes(piece[: len(out)]), bytes(piece[len(out) :])
            else:
                data = self.inflate.decompress(piece, len(out))
                self.rest = self.inflate.unconsumed_tail
        if not data and self.inflate is not None:
            data = self.inflate.decompress(b"", len(out))
        self.seen, self.crc = self.seen + len(data), zlib.crc32(data, self.crc)
        if not data and (self.seen, self.crc) != self.want:
            raise zipfile.BadZipFile("a member is cut off or damaged")
        out[: len(data)] = data
        return len(data)


def _inflated_lines(batches):
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(4)), strict=True):
            method, packed, crc, n_bytes = (v.as_py() for v in row)
            yield from _lines_of(io.BufferedReader(_Inflated(method, packed, crc, n_bytes)))


def scan_archives(spark, paths):
    """One row per zip file: path, length and content. Nothing is extracted or deleted."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def lines_from_archives(archives):
    """The lines (column `line`) of the members of (path, content) rows, an archive in one task."""
    lines = archives.select("content").mapInArrow(_member_lines, "line STRING")
    return lines.select(F.rtrim("line", F.lit("\n")).alias("line"))


def lines_from_members(archives, n_tasks=None):
    """As `lines_from_archives`, with each member in a task of its own.

    One task reads an archive and cuts it by its directory; the compressed members are dealt out,
    so that decompressing and parsing a large archive is shared among tasks.
    """
    packed = archives.select("path", "content").mapInArrow(
        _packed_members, "path STRING, member STRING, method INT, packed_bytes BINARY, crc BIGINT, n_bytes BIGINT"
    )
    keys = ["path", "member"]
    dealt = packed.repartition(n_tasks, *keys) if n_tasks else packed.repartition(*keys)
    lines = dealt.select("method", "packed_bytes", "crc", "n_bytes").mapInArrow(_inflated_lines, "line STRING")
    return lines.select(F.rtrim("line", F.lit("\n")).alias("line"))


def archive_lines(spark, paths, large=LARGE_ARCHIVE):
    """The lines of zip files: small ones are read in place, those of over `large` bytes by member."""
    found = scan_archives(spark, paths)
    small, big = found.where(F.col("length") <= large), found.where(F.col("length") > large)
    return lines_from_archives(small).unionByName(lines_from_members(big))


def rows_from_archives(archives, ddl):
    """Parse the members of (path, content) rows with the given schema, inside the JVM."""
    return parsed_lines(lines_from_archives(archives), ddl)


def read_zipped_events(spark, paths, large=LARGE_ARCHIVE):
    return parsed_lines(archive_lines(spark, paths, large), RAW_EVENT)


def read_zipped_gkg(spark, paths, large=LARGE_ARCHIVE):
    return parsed_lines(archive_lines(spark, paths, large), RAW_GKG)
