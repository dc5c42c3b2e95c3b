"""WARC records in ZIP packages: writing, and range reads without extraction.

A package holds stored (not compressed) members: `archive/data.warc.gz`, in which every record is
a gzip member of its own, and `indexes/index.cdx` with the place of each record. A reader parses
the ZIP directories from the end of the file, finds the stored members, and then reads just the
byte ranges of records, so the records of one package are spread over many tasks.
"""

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F

# Compressed bytes after which a package is closed.
PACKAGE_BYTES = 32 << 20
# Bytes of a package that one reading task takes.
RANGE_BYTES = 16 << 20
# Payloads of fewer bytes are written in full each time.
MIN_REVISIT_BYTES = 0
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID_PREFIX = "urn:newslens:page:"
RECORD = "record_id string, record_type string, url string, digest string, payload_bytes long, refers_to string, payload binary"


# ------------------------------------------------------------------------------------ writing

def base32_digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_uri(page_id):
    return f"<{ID_PREFIX}{page_id}>"


def warc_record(page_id, url, digest, payload, payload_bytes, refers_to):
    """One WARC/1.1 record, a response if it has a payload and otherwise a revisit."""
    url = (url or "about:blank").translate({c: f"%{c:02X}" for c in (*range(33), 127)})
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_uri(refers_to)}",
        ]
    block = HTTP_HEAD + (payload or b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip_member(data):
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def package(records):
    """A ZIP file of stored members for (url, gzip member) records. Its comment is a line break."""
    index, offset = [], 0
    for url, member in records:
        place = {"offset": offset, "length": len(member), "filename": "data.warc.gz"}
        index.append(f"{url} {json.dumps(place)}\n")
        offset += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.comment = b"\n"
        archive.writestr("archive/data.warc.gz", b"".join(member for _, member in records))
        archive.writestr("indexes/index.cdx", "".join(index))
    return out.getvalue()


def _records(pages, page_id, url, html, min_revisit_bytes):
    """(page_id, url, digest, payload_bytes, refers_to, payload); payload only for responses.

    Pages are grouped by digest with a map-side aggregate, so a payload that a third of all pages
    share costs nothing extra. Payloads travel once, by page, and only where they are written.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    full = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"),
    )
    narrow = full.drop("payload")
    last = narrow.groupBy("digest").agg(F.max("page_id").alias("last_id"))
    in_full = F.col("page_id").eqNullSafe(F.col("last_id")) | (F.col("payload_bytes") < min_revisit_bytes)
    judged = narrow.join(last, "digest").withColumn("in_full", in_full)
    revisits = judged.where("NOT in_full").select(
        "page_id", "url", "digest", "payload_bytes", F.col("last_id").alias("refers_to"),
        F.lit(None).cast("binary").alias("payload"),
    )
    written = judged.where("in_full").select(
        F.col("page_id").alias("id"), F.col("digest").alias("of_digest")
    )
    responses = full.join(
        written, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of_digest")),
        "left_semi",
    ).select(
        "page_id", "url", "digest", "payload_bytes",
        F.lit(None).cast(pages.schema[page_id].dataType).alias("refers_to"), "payload",
    )
    return responses.unionByName(revisits)


def write_packages(pages, path, page_id="page_id", url="url", html="html",
                   min_revisit_bytes=MIN_REVISIT_BYTES, package_bytes=PACKAGE_BYTES):
    """Write a WARC record per row of `pages` into ZIP packages under `path`.

    Of rows with equal payloads (at least `min_revisit_bytes` long) the one with the largest
    page_id is a response and the others revisit it; if that id comes twice, both are responses.
    A NULL html is an empty payload; a NULL page_id counts as the smallest, and a NULL url is
    written as about:blank.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for page, url, digest, length, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                record = warc_record(page, url, digest, payload, length, refers_to)
                held.append((f"page:{page}", _gzip_member(record)))
                size += len(held[-1][1])
                if size >= package_bytes:
                    yield _one_row(package(held))
                    held, size = [], 0
        if held:
            yield _one_row(package(held))

    def _one_row(content):
        # The text writer ends each row with a line break: the last byte of the package.
        return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], ["content"])

    packed = _records(pages, page_id, url, html, min_revisit_bytes).mapInArrow(run, "content binary")
    # A file per row. Spark's own writer reaches any file system and survives repeated tasks.
    packed.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\n"
    ).text(path)


# ------------------------------------------------------------------------------------ reading

def _open(uri):
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _at(file, offset, length):
    file.seek(offset)
    return file.read(length)


def zip_members(file, size):
    """{name: (offset of its data, length)} of the stored members of a ZIP file.

    Reads the end record, the ZIP64 records where the end record refers to them, the central
    directory, and of each member's local header the two lengths that place its data.
    """
    tail_start = max(0, size - 65557)
    tail = _at(file, tail_start, size - tail_start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, end + 4)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _at(file, tail_start + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    directory, members, at = _at(file, start, length), {}, 0
    for _ in range(count):
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        packed, plain, header = _wide(extra, packed, plain, header)
        if method == zipfile.ZIP_STORED:
            lengths = struct.unpack("<HH", _at(file, header + 26, 4))
            members[name] = (header + 30 + sum(lengths), packed)
    return members


def _wide(extra, packed, plain, header):
    """The 64-bit values of a directory entry, which stand in a ZIP64 extra field in fixed order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            at += 4
            values = []
            for value in (plain, packed, header):
                if value == 0xFFFFFFFF:
                    value, = struct.unpack_from("<Q", extra, at)
                    at += 8
                values.append(value)
            return values[1], values[0], values[2]
        at += 4 + length
    return packed, plain, header


def _gzip_starts(file, start, length):
    """(offset, length) of the gzip members of a stored archive that no index covers."""
    at, end = start, start + length
    while at < end:
        unpacker, first = zlib.decompressobj(31), at
        while not unpacker.eof:
            piece = _at(file, at, min(1 << 20, end - at))
            if not piece:
                raise ValueError("a gzip member is cut off")
            unpacker.decompress(piece)
            at += len(piece) - len(unpacker.unused_data)
        yield first, at - first


def record_places(file, size):
    """(offset, length) of each WARC record in a package, from its indexes where it has them."""
    members = zip_members(file, size)
    archives = {n.split("/", 1)[1]: m for n, m in members.items() if n.startswith("archive/") and n.endswith(".warc.gz")}
    indexed = set()
    for name, (start, length) in members.items():
        if name.startswith("indexes/") and name.endswith(".cdx"):
            for line in _at(file, start, length).decode().splitlines():
                place = json.loads(line[line.index("{"):])
                indexed.add(place["filename"])
                yield archives[place["filename"]][0] + place["offset"], place["length"]
    for name, (start, length) in archives.items():
        if name not in indexed:
            yield from _gzip_starts(file, start, length)


def parse_record(data):
    """(header fields by lower-case name, payload without the HTTP head) of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_packages(spark, path, with_payload=False):
    """A row per WARC record of the ZIP packages under `path`.

    digest and payload_bytes of a response come from its payload, and an error is raised if the
    stated digest differs; those of a revisit are stated in the record.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def locate(batches):
        for batch in batches:
            for uri, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(uri) as file:
                    places = list(record_places(file, size))
                offsets, lengths = zip(*places, strict=True) if places else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(places), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["path", "offset", "length"],
                )

    def rows_of(records):
        columns = list(zip(*records, strict=True)) if records else [()] * 7
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        names = ["record_id", "record_type", "url", "digest", "payload_bytes", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def record(file, offset, length):
        fields, payload = parse_record(zlib.decompress(_at(file, offset, length), 31))
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        n_bytes = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
        kind = fields["warc-type"]
        if kind == "response":
            n_bytes = len(payload)
            if base32_digest(payload) != stated:
                raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
        return (
            fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), stated, n_bytes,
            fields.get("warc-refers-to", "").strip("<>") or None, payload if with_payload else None,
        )

    def read(batches):
        uri, file, held, size = None, None, [], 0
        for batch in batches:
            for place, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != uri:
                    uri, file = place, _open(place)
                held.append(record(file, offset, length))
                size += length
                if size >= BATCH_BYTES:
                    yield rows_of(held)
                    held, size = [], 0
        yield rows_of(held)

    places = files.mapInArrow(locate, "path string, offset long, length long")
    # Places are small rows for large reads, so tasks are counted by the bytes they stand for, and
    # adaptive execution keeps a given number. Half ranges spread more evenly over twice as many.
    n_bytes = files.agg(F.sum("length")).first()[0] or 0
    block = F.floor(F.col("offset") * 2 / RANGE_BYTES)
    dealt = places.repartition(2 * max(1, -(-n_bytes // RANGE_BYTES)), "path", block)
    dealt = dealt.sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, RECORD)


def page_of(uri):
    """page_id in a record's URI; NULL for a page without id."""
    return F.substring_index(uri, ":", -1).try_cast("long")
