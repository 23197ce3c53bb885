"""Web archives: pages to WARC records, whole-file gzip to one gzip member for each record, and back.

Writing: every task writes its pages as records of WARC files, each file a single gzip stream, begins a new
file after ``ARCHIVE_BYTES`` of records, and returns a narrow row for each record (file, place, id, digest of the
payload). Such a file can only be read from its start.

Normalising: a file is inflated once, as a stream, whatever its gzip members are. Each record is written again as a
member of its own, and a sidecar beside the file gets its place, offset, length, type and record id. Records that
repeat another one's payload become revisits on the way: HTTP header and no payload. Pages themselves never go
through a shuffle: which records repeat which is settled on the narrow rows, grouped by digest with partial
minima, and only the repeats go to the task that rewrites their file. One file is the work of one task, hence the
bound on its size.

Reading: sidecars are cut into spans of members of about ``SPAN_BYTES``, which are dealt over the tasks; a task opens
the file at the span's offset and inflates members one by one. Payload digests are computed again from what is
read and must equal the record's header.

Files are named after the attempt that wrote them and count only if its task ended well: the tables of files
and records are written by Spark, so a lost executor or a second attempt leaves nothing but a file that nobody
reads. Files are read and written in pieces, so a record needs no more memory than its page does as a row. The
folder is one that all executors reach, by a path that pyarrow opens (local or shared mount, hdfs, s3, gs).

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the response, the
others are its revisits; records with smaller payloads are all responses. Null ids come last; if two records share
payload and id, just one of them is the response and the other refers to the same id. A null payload is an empty one.
Payloads are kept byte by byte. A null url gives a record without target, blanks and control characters in a url are
percent-encoded in the header. An empty table gives no files and no rows. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import text_chunks
from flowlens.runtime import column as named
from flowlens.runtime import materialise, scratch_path

#: Bytes of records, before compression, after which a file is closed.
ARCHIVE_BYTES = 1 << 28
#: Bytes of compressed members that are read as one piece of work.
SPAN_BYTES = 1 << 22
#: Bytes of compressed members that a task reads, where the session's usual number of tasks would read more.
TASK_BYTES = 1 << 27
#: The date of written records unless another one is given.
DATE = "1970-01-01T00:00:00Z"
_PIECE = 1 << 18
_MOST_HEADER = 1 << 20
_GZIP = 31
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    if re.match(r"file:/(?!//)", path):
        path = path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{archive}/{place}')}>"


def _head(fields: list[tuple[str, str]], version: str = "WARC/1.1") -> bytes:
    return "".join([f"{version}\r\n", *[f"{name}: {value}\r\n" for name, value in fields], "\r\n"]).encode()


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda x: quote(x.group()), url)


# Reading streams -------------------------------------------------------------------------------


class Inflated:
    """The bytes behind a gzip file or a part of it, member after member, in pieces."""

    def __init__(self, raw, length: int | None = None):
        self.raw, self.left = raw, length
        self.inflate, self.rest, self.data, self.at = None, b"", b"", 0

    def more(self) -> bytes:
        """The next piece, at most ``_PIECE`` bytes; empty at the end."""
        while True:
            if not self.rest:
                size = _PIECE if self.left is None else min(_PIECE, self.left)
                self.rest = self.raw.read(size) if size else b""
                if self.left is not None:
                    self.left -= len(self.rest)
                if not self.rest:
                    if self.inflate is not None:
                        raise ValueError("the archive ends inside a gzip member")
                    return b""
            if self.inflate is None:
                self.inflate = zlib.decompressobj(_GZIP)
            out = self.inflate.decompress(self.rest, _PIECE)
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, None
            else:
                self.rest = self.inflate.unconsumed_tail
            if out:
                return out

    def head(self) -> bytes | None:
        """A record's header with its blank line; nothing at the end."""
        seen = self.at
        while (end := self.data.find(b"\r\n\r\n", seen)) < 0:
            seen = max(self.at, len(self.data) - 3)
            piece = self.more()
            if not piece:
                if self.data[self.at :].strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
            seen -= self.at
            self.data, self.at = self.data[self.at :] + piece, 0
            if len(self.data) > _MOST_HEADER + _PIECE:
                raise ValueError("a record has no header")
        out = self.data[self.at : end + 4]
        self.at = end + 4
        return out

    def pieces(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes."""
        while length:
            if self.at == len(self.data):
                self.data, self.at = self.more(), 0
                if not self.data:
                    raise ValueError("the archive ends inside a record")
            out = self.data[self.at : self.at + length]
            self.at += len(out)
            length -= len(out)
            yield out


def parse_head(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    lines = head.decode("utf-8").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return lines[0], [(name, value.strip()) for name, _, value in (x.partition(":") for x in lines[1:])]


def records(stream: Inflated) -> Iterator[tuple[str, dict[str, str], "Block"]]:
    """(version, fields, block) of each record. What the caller leaves of a block is passed over."""
    while (head := stream.head()) is not None:
        version, fields = parse_head(head)
        fields = dict(fields)
        length = int(fields["Content-Length"])
        block = Block(stream, length)
        yield version, fields, block
        for _ in block:
            pass
        if b"".join(stream.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")


class Block:
    """The block of a record in pieces, read at most once."""

    def __init__(self, stream: Inflated, length: int):
        self.length, self.source = length, stream.pieces(length)

    def __iter__(self) -> Iterator[bytes]:
        return self.source

    def http_head(self) -> tuple[bytes, bytes]:
        """(HTTP header with its blank line, what was read of the payload)."""
        seen = b""
        for piece in self.source:
            seen += piece
            if (end := seen.find(b"\r\n\r\n")) >= 0:
                return seen[: end + 4], seen[end + 4 :]
        return seen, b""


# Writing ---------------------------------------------------------------------------------------


class _Whole:
    """A WARC file as one gzip stream."""

    def __init__(self, fs, path: str, date: str):
        self.path, self.date, self.size, self.place = path, date, 0, 0
        self.out, self.deflate = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, _GZIP)
        info = b"format: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, 0)), ("WARC-Date", date)]
        self.put(_head([*fields, ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]), info)

    def put(self, *pieces: bytes) -> None:
        for piece in (*pieces, b"\r\n\r\n"):
            self.size += len(piece)
            self.out.write(self.deflate.compress(piece))
        self.place += 1

    def response(self, page: str | None, url: str | None, payload: bytes, digest: bytes) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(self.path, self.place)), ("WARC-Date", self.date)]
        fields += [("WARC-Target-URI", _target(url))] if url else []
        fields += [("X-Page-Id", quote(page, safe=""))] if page is not None else []
        fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(digest)}"), ("Content-Type", "application/http; msgtype=response")]
        self.put(_head([*fields, ("Content-Length", str(len(http) + len(payload)))]), http, payload)

    def close(self) -> None:
        self.out.write(self.deflate.flush())
        self.out.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(``archive``, ``place``, ``id``, ``digest``, ``bytes``) of the records, after writing them below ``folder``."""
    rows = pages.select(named(id_col).alias("id"), named(id_col).cast("string").alias("page"), named(url_col).cast("string").alias("url"), named(html_col).cast("string").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem, files, whole = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            page, url = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            places, digests, sizes = [], [], []
            for first, last, data, offsets in text_chunks(batch.column(3)):
                raw = data.tobytes()
                for k in range(last - first):
                    if whole is None or whole.size >= ARCHIVE_BYTES:
                        if whole is not None:
                            whole.close()
                        whole = _Whole(fs, f"{base}/{stem}-{files}.warc.gz", date)
                        files += 1
                    payload = raw[offsets[k] : offsets[k + 1]]
                    digests.append(hashlib.sha1(payload).digest())
                    sizes.append(len(payload))
                    places.append((whole.path, whole.place))
                    whole.response(page[first + k], url[first + k], payload, digests[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in places], pa.string()),
                    pa.array([n for _, n in places], pa.int64()),
                    batch.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["archive", "place", "id", "digest", "bytes"],
            )
        if whole is not None:
            whole.close()

    kind = rows.schema["id"].dataType.simpleString()
    written = rows.mapInArrow(work, f"archive string, place bigint, id {kind}, digest binary, bytes bigint")
    # written down: another run of a task would name other files
    return materialise(written, "written")


def repeats(written: DataFrame, least: int = 0) -> DataFrame:
    """(``archive``, ``place``, ``to_archive``, ``to_place``, ``to_page``) of the records that repeat another payload.

    A digest of very many records is one row on the right side; adaptive execution splits its rows on the left.
    """
    long = written.where(F.col("bytes") >= least)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "archive", "place")).alias("first")
    firsts = long.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "first")
    both = long.select("digest", "archive", "place").join(firsts, "digest")
    both = both.where((F.col("archive") != F.col("first.archive")) | (F.col("place") != F.col("first.place")))
    return both.select("archive", "place", F.col("first.archive").alias("to_archive"), F.col("first.place").alias("to_place"), F.col("first.id").cast("string").alias("to_page"))


# Normalising -----------------------------------------------------------------------------------


def normalise_archive(fs, source: str, target: str, wanted: Iterator[tuple], level: int = 6) -> tuple[int, int]:
    """Rewrite one file with a member for each record and its sidecar; (records, bytes) of the new file.

    ``wanted`` are the records to turn into revisits, (place, archive, place and page of the response), by place.
    """
    offset, place, revisit = 0, 0, next(wanted, None)
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(f"{target}.idx", compression=None) as idx:
        for version, fields, block in records(Inflated(raw)):
            if revisit is not None and revisit[0] == place:
                http, _ = block.http_head()
                _, archive, other, page = revisit
                fields |= {"WARC-Type": "revisit", "WARC-Profile": _REVISIT, "WARC-Refers-To": record_id(archive, other), "Content-Length": str(len(http))}
                fields |= {"X-Refers-To-Page-Id": quote(page, safe="")} if page is not None else {}
                body, revisit = iter([http]), next(wanted, None)
            else:
                body = iter(block)
            member = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
            size = out.write(member.compress(_head(list(fields.items()), version)))
            for piece in body:
                size += out.write(member.compress(piece))
            size += out.write(member.compress(b"\r\n\r\n") + member.flush())
            idx.write(f"{place}\t{offset}\t{size}\t{fields['WARC-Type']}\t{fields['WARC-Record-ID']}\n".encode())
            offset, place = offset + size, place + 1
    return place, offset


def normalise_archives(archives: DataFrame, folder: str, revisits: DataFrame | None = None) -> DataFrame:
    """(``archive``, ``records``, ``bytes``) of new files below ``folder`` for the files of ``archives`` (``archive``).

    Any WARC file in gzip will do, whatever its members. Each new file has its sidecar beside it: ``.idx`` with place,
    offset, length, type and record id of every record, tab-separated, a line each.
    """
    spark = archives.sparkSession
    fields = "archive string, place bigint, to_archive string, to_place bigint, to_page string"
    rows = archives.select("archive").distinct().select("archive", F.lit(-1).cast("bigint").alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in (("to_archive", "string"), ("to_place", "bigint"), ("to_page", "string"))])
    rows = rows.unionByName(revisits if revisits is not None else spark.createDataFrame([], fields))
    # as many tasks as files: the rows are few, but the work behind each file is not
    files = max(1, archives.select("archive").distinct().count())
    dealt = rows.repartition(files, "archive").sortWithinPartitions("archive", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        each = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for number, (archive, group) in enumerate(groupby(each, key=lambda row: row[0])):
            next(group)  # the row of the file itself, which is the first
            target = f"{base}/{attempt}-{number}.warc.gz"
            count, size = normalise_archive(fs, archive, target, (row[1:] for row in group))
            yield pa.RecordBatch.from_pydict({"archive": [target], "records": [count], "bytes": [size]})

    return materialise(dealt.mapInArrow(work, "archive string, records bigint, bytes bigint"), "archives")


# Reading back ----------------------------------------------------------------------------------


def _spans(folder: str):
    """Of each file the ranges of whole members of about SPAN_BYTES, from its sidecar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                start = end = 0
                with fs.open_input_stream(f"{archive}.idx", compression=None) as raw:
                    rows = []
                    for line in _lines(raw):
                        _, offset, size, _, _ = line.split("\t")
                        end = int(offset) + int(size)
                        if end - start >= SPAN_BYTES:
                            rows.append((archive, start, end))
                            start = end
                    if end > start:
                        rows.append((archive, start, end))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "start", "end"])

    return work


def _lines(raw) -> Iterator[str]:
    held = b""
    while piece := raw.read(_PIECE):
        *whole, held = (held + piece).split(b"\n")
        for line in whole:
            yield line.decode()


_READ = [
    ("archive", "string"), ("offset", "bigint"), ("record_type", "string"), ("record_id", "string"), ("page", "string"), ("url", "string"),
    ("payload_bytes", "bigint"), ("payload_digest", "string"), ("refers_to_record", "string"), ("refers_to_page", "string"),
]


def read_archives(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """A row for each response and revisit of normalised files (``archive``), with the payload as ``html`` if asked for.

    ``offset`` is where the span begins that the record was read in. Size and digest are those of the whole payload; for a revisit its header has them.
    """
    spans = archives.select("archive").mapInArrow(_spans(folder), "archive string, start bigint, end bigint")
    names = [*[c for c, _ in _READ], *(["html"] if payload else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for batch in batches:
            for archive, start, end in zip(*[c.to_pylist() for c in batch.columns]):
                rows = []
                with fs.open_input_file(archive) as raw:
                    raw.seek(start)
                    for _, fields, block in records(Inflated(raw, end - start)):
                        if fields["WARC-Type"] in ("response", "revisit"):
                            rows.append((archive, start, *_read(fields, block, payload)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64() if c in ("offset", "payload_bytes") else pa.string()) for k, c in enumerate(names)], names=names
                )

    schema = ", ".join([*[f"{c} {t}" for c, t in _READ], *(["html string"] if payload else [])])
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    return spans.repartition(tasks, "archive", "start").mapInArrow(work, schema)


def _read(fields: dict[str, str], block: Block, payload: bool) -> tuple:
    http, rest = block.http_head()
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kept = []
    if fields["WARC-Type"] == "response":
        sha, seen = hashlib.sha1(rest), len(rest)
        kept.append(rest)
        for piece in block:
            sha.update(piece)
            seen += len(piece)
            if payload:
                kept.append(piece)
        if base32_sha1(sha.digest()) != digest or seen != size:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its header says")
    page, to_page = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    row = (
        fields["WARC-Type"], fields["WARC-Record-ID"], None if page is None else unquote(page), fields.get("WARC-Target-URI"), size, digest,
        fields.get("WARC-Refers-To"), None if to_page is None else unquote(to_page),
    )
    return (*row, b"".join(kept).decode("utf-8") if kept else None) if payload else row


def remove_folder(folder: str) -> None:
    fs, base = open_folder(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = DATE) -> DataFrame:
    """Write pages as WARC files with a member for each record; (``archive``, ``records``, ``bytes``) of the files.

    The whole-file streams are written below ``folder`` first and removed once they are normalised.
    """
    written = write_archives(pages, f"{folder}/whole", id_col, url_col, html_col, date)
    archives = normalise_archives(written, f"{folder}/members", repeats(written, least))
    remove_folder(f"{folder}/whole")
    return archives


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``) of the pages, as read back from their archives."""
    folder = scratch_path(pages.sparkSession, "warc")
    read = read_archives(archive_pages(pages, folder, id_col, url_col, html_col, least), f"{folder}/members")
    kind = pages.schema[id_col].dataType
    return read.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast(kind).alias("refers_to"))
