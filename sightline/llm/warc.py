"""WARC archives: writing, normalising whole-file gzip streams, reading by an offset index.

``write_archives`` writes pages as WARC 1.1 records. Spark's own text writer
puts the records of a partition into one gzip stream, so an archive made this
way is monolithic: its records can only be reached from the front.
``normalise`` inflates each such stream once, in bounded pieces, and writes
every record as a gzip member of its own, with a sidecar index of offsets.
``read_records`` takes the index, deals its rows out by byte ranges and opens
just the members named. Archives written elsewhere may be whole streams or
have members already; both are normalised the same way.

A payload of at least ``LEAST_SHARED`` bytes is written once, in the response
record with the largest page id; other pages with the same bytes become
revisit records that refer to it. Rows that tie for the largest id are all
responses; null ids are smaller than any other, and null html is an empty
payload. Repeated rows give a record each. Control characters and spaces of an
address are percent-encoded, a null address is ``urn:page``.

Files are written under names of their own and count only if the index table
or the success mark names them, so a task that ran twice leaves a stray file
and no wrong row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked
from sightline.session import durable, durable_path

LEAST_SHARED = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Bytes inflated at a time.
PIECE = 1 << 20
#: Bytes of archive that a reading task takes.
RANGE = 32 << 20
INDEX = (
    "archive string, offset long, length long, record_id string, record_type string, page_id long, "
    "target_uri string, payload_digest string, refers_to string"
)


# Records


def _address(url: Column) -> Column:
    """An address that holds no space and no control character."""
    for char in (" ", "\t", "\n", "\r"):
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%20")


def with_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``pages`` (page_id, url, html) with payload bytes, digest, type and what a revisit refers to.

    Only digests that occur more than once are joined back; the join is between
    two written or scanned tables, so a digest of many rows can be split.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    told = pages.withColumns({
        "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload), "_key": F.sha2(payload, 256),
    })
    long_ones = told.where(F.col("payload_bytes") >= least)
    shared = long_ones.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last"))
    shared = durable(shared.where("_n > 1").select("_key", "_last"), "warc-shared")
    revisits = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    joined = told.join(shared, "_key", "left").withColumn("record_type", F.when(revisits, "revisit").otherwise("response"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("_last"))).drop("_key", "_last")


def _record_id(page_id: Column, digest: Column) -> Column:
    """The id of a response: fixed by the page and its payload, so a revisit can name it."""
    told = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    parts = [F.substring(told, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(date: str = DATE) -> Column:
    """A whole record from the columns of ``with_types``, without the two line ends after it."""
    revisit = F.col("record_type") == "revisit"
    html = F.coalesce("html", F.lit(""))
    own = _record_id(F.col("page_id"), F.concat("payload_digest", F.col("record_type")))
    other = _record_id(F.col("refers_to"), F.concat("payload_digest", F.lit("response")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n")
    )
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    optional = [
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), other, F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")),
    ]
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), own), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _address(F.coalesce("url", F.lit("urn:page")))), *optional,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)), F.lit(""), F.lit(""),
    )
    return F.concat(head, block)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = LEAST_SHARED,
) -> None:
    """One WARC record per row; every partition is one gzip stream below ``folder``."""
    typed = with_types(picked(pages, page_id=id_col, url=url_col, html=html_col), least)
    typed.select(record_text()).write.option("compression", "gzip").option("lineSep", RECORD_END).text(folder)


# Streams


class _Stream:
    """Bytes of a gzip file, whatever its members, inflated a piece at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.raw, self.held = file, b"", bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            self.raw = self.inflate.unused_data or self.raw
            self.inflate = zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.file.read(PIECE)
            if not self.raw:
                return False
        data = self.inflate.decompress(self.raw, PIECE)
        self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
        self.held += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """All bytes up to and with the next mark; None at the end of the file."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends inside a record head")
                return None
        return self.take(found + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        data = bytes(self.held[:size])
        del self.held[:size]
        return data

    def skip_line_ends(self) -> None:
        while True:
            kept = self.held.lstrip(b"\r\n")
            if kept or not self._more():
                self.held = bytearray(kept)
                return


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a record head by lower-case name; lines that begin with a space go on with the line before."""
    first, *lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, head, block) of every record of an archive; one record is held at a time."""
    stream = _Stream(file)
    stream.skip_line_ends()
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_head(head)
        yield fields, head, stream.take(int(fields["content-length"]))
        stream.skip_line_ends()


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head, if it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def member(head: bytes, block: bytes) -> bytes:
    """A record as a gzip file of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + RECORD_END.encode()) + packer.flush()


def _entry(fields: dict[str, str], archive: str, offset: int, length: int) -> dict[str, Any]:
    page, other = fields.get("x-page-id"), fields.get("warc-refers-to")
    return {
        "archive": archive, "offset": offset, "length": length, "record_id": fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"), "page_id": int(page) if page else None,
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": other,
    }


def _opened(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# Operators


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the gzip files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "length")


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrite every archive of ``folder`` below ``target``: a gzip member per record, and a sidecar ``.idx``.

    Returns (archive, sidecar, records) of what was written, as a written table.
    A task inflates one stream, holds one record at a time and appends to one
    file; nothing comes back to the driver.
    """
    listed = archives(spark, folder)
    many = max(listed.count(), 1)
    base = target.rstrip("/")

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for (paths,) in batches:
            for path in paths:
                yield tuple([x] for x in _normalise_one(path, base))

    spread = listed.select("path").repartition(many, "path")
    return durable(by_rows(spread, run, "archive string, sidecar string, records long"), "warc-normalised")


def _normalise_one(path: str, base: str) -> tuple[str, str, int]:
    source, at = _opened(path)
    sink, folder = _opened(base)
    sink.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    archive, sidecar = f"{base}/{name}.warc.gz", f"{base}/{name}.idx"
    offset = count = 0
    with (
        source.open_input_stream(at, compression=None) as file,
        sink.open_output_stream(f"{folder}/{name}.warc.gz", compression=None) as out,
        sink.open_output_stream(f"{folder}/{name}.idx", compression=None) as index,
    ):
        for fields, head, block in records(file):
            data = member(head, block)
            out.write(data)
            index.write(json.dumps(_entry(fields, archive, offset, len(data))).encode() + b"\n")
            offset += len(data)
            count += 1
    return archive, sidecar, count


def read_index(spark: SparkSession, written: DataFrame) -> DataFrame:
    """The rows of all sidecars named by ``written``, read where they are."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        names = [part.split()[0] for part in INDEX.split(", ")]
        for (sidecars,) in batches:
            for uri in sidecars:
                fs, at = _opened(uri)
                with fs.open_input_stream(at, compression=None) as raw:
                    held = b""
                    while data := raw.read(PIECE):
                        *lines, held = (held + data).split(b"\n")
                        if lines:
                            entries = [json.loads(x) for x in lines]
                            yield tuple([e[n] for e in entries] for n in names)

    return by_rows(written.select("sidecar"), run, INDEX)


def read_records(index: DataFrame, total: int | None = None) -> DataFrame:
    """(page_id, record_id, record_type, refers_to, block_payload_bytes, block_payload_digest) of every index row.

    Rows are dealt out by ranges of ``RANGE`` bytes of an archive and read in
    order of offset, each member by itself.
    """
    if total is None:
        total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, 2 * total // RANGE + 1)
    dealt = index.repartition(parts, "archive", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        name, file = None, None
        for uris, offsets, lengths in batches:
            rows = []
            for uri, offset, length in zip(uris, offsets, lengths, strict=True):
                if uri != name:
                    if file:
                        file.close()
                    fs, at = _opened(uri)
                    name, file = uri, fs.open_input_file(at)
                file.seek(offset)
                raw = zlib.decompress(file.read(length), 31)
                end = raw.index(b"\r\n\r\n") + 4
                fields = parse_head(raw[:end])
                block = raw[end : end + int(fields["content-length"])]
                payload = payload_of(fields, block)
                page = fields.get("x-page-id")
                rows.append((
                    int(page) if page else None, fields.get("warc-record-id"), fields["warc-type"],
                    fields.get("warc-refers-to"), len(payload), hashlib.sha1(payload).hexdigest(),
                ))
            if rows:
                yield tuple(zip(*rows, strict=True))
        if file:
            file.close()

    schema = (
        "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string"
    )
    return by_rows(dealt.select("archive", "offset", "length"), run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Records as read, revisits with the payload size, digest and page id of the response they refer to."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    plain = found.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    named = found.where("record_type = 'revisit'").select("page_id", F.col("refers_to_id").alias("record_id"))
    wanted = named.select("record_id").distinct()
    whole = found.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    # Rows alike in every column that tie for the largest id share a record id.
    whole = whole.groupBy("record_id").agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"),
        F.max("payload_digest").alias("payload_digest"),
    )
    whole = durable(whole, "warc-referred")
    back = named.join(whole, "record_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"
    )
    return plain.union(back)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive."""
    spark = pages.sparkSession
    whole, members = durable_path(spark, "warc-streams"), durable_path(spark, "warc-members")
    write_archives(pages, whole, id_col, url_col, html_col)
    written = normalise(spark, whole, members)
    index = durable(read_index(spark, written), "warc-index")
    return resolved(durable(read_records(index), "warc-records"))
