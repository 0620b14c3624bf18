"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and both formats written and read.

An ARC file begins with a version block; each record is a header line, its fields by the version, whose last-but-version
field is the length declared for the content behind it. The converter reads records by these lengths alone and gives each
its WARC form: a record id made from its place and content, the 14-digit date as a timestamp, the type by scheme and
content, SHA-1 digests of block and payload. Of records with equal payloads one is a response, the others become
revisits that refer to it and carry HTTP headers alone. Records are gzip members, so files can be read from any of them.

A task writes each file under a name of its own and moves it into place; tables of files hold only those of tasks that
ended well. Payloads never leave the tasks that convert them: what is shuffled is a digest for each record.

Defined results: a null payload is empty; payloads of fewer than `least` bytes are responses all; a null page id loses
every tie; equal page ids with equal payloads: the later place in the archive is the response; white space and control
characters of a URL are percent-encoded in its header, a null URL is `urn:unknown`; an empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import arrow_schema, column, materialise, partitions, pieces, scratch, ship

#: Compressed bytes and records after which a file ends.
FILE_BYTES, FILE_RECORDS = 8 << 20, 5_000
#: Bytes that are given to the decompressor at once.
GIVEN = 1 << 14
#: Fields of the header line of each ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"
_FILES = "path string, part long, seq int, records int, bytes long"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, or the whole of one that isn't compressed. Work grows with the file, not with its members' number times it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + GIVEN]
            out.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)  # at most GIVEN bytes, copied
        yield b"".join(out)


def quoted(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"


# --- ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    text = f"{version} 0 gleaner\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_record(version, values, text)


def arc_record(version: int, values: dict[str, str], content: bytes) -> bytes:
    line = " ".join(str(len(content)) if f == "Archive-length" else values.get(f) or "-" for f in ARC_FIELDS[version])
    return line.encode() + b"\n" + content + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, the version block first. Records follow declared lengths, never a search."""
    version = None
    for chunk in members(data):
        at = 0
        while at < len(chunk):
            if chunk[at : at + 1] in (b"\n", b"\r"):  # records are set apart by line ends
                at += 1
                continue
            end = chunk.index(b"\n", at)
            parts = chunk[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
            if version is None and not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            size = int(parts[-1])
            content = chunk[end + 1 : end + 1 + size]
            if len(content) < size:
                raise ValueError("an ARC record is shorter than it declares")
            if version is None:
                version = int(content.split(None, 1)[0])
            fields = ARC_FIELDS[version]
            # the version block has the fields of version 1 in many old files, whatever the version
            names = fields if len(parts) == len(fields) else ARC_FIELDS[1]
            if len(parts) != len(names):
                raise ValueError(f"an ARC header line has {len(parts)} fields")
            yield dict(zip(names, parts, strict=True)), content
            at = end + 1 + size


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Headers with the empty line behind them, and payload; content that isn't HTTP is payload alone."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    size = 4
    if end < 0 or 0 <= content.find(b"\n\n") < end:
        end, size = content.find(b"\n\n"), 2
    return (content[: end + size], content[end + size :]) if end >= 0 else (content, b"")


def header(block: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", block)
    return m[1].strip() if m else None


# --- WARC


def warc_date(arc_date: str) -> str:
    d = (arc_date + "0" * 14)[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    for chunk in members(data):
        at = 0
        while at < len(chunk):
            end = chunk.index(b"\r\n\r\n", at)
            head, *lines = chunk[at:end].decode("utf-8", "replace").split("\r\n")
            if not head.startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(fields["content-length"])
            block = chunk[end + 4 : end + 4 + size]
            if len(block) < size or chunk[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("a WARC record's length is wrong")
            yield fields, block
            at = end + 8 + size


def convert_record(fields: dict[str, str], content: bytes, rid: str, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; refers: record id, URL and date of the response with the same payload."""
    head, payload = http_parts(content)
    url = fields["URL"]
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        content = f"software: gleaner\r\nformat: WARC file version 1.1\r\nconverted-from: {url}\r\n".encode()
    elif head:
        kind, mime = ("revisit" if refers else "response"), "application/http; msgtype=response"
    else:
        kind, mime = ("revisit" if refers else "response" if url.startswith("dns:") else "resource"), fields["Content-type"]
    out = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", warc_date(fields["Archive-date"]))]
    if kind != "warcinfo":
        out += [("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if kind == "revisit":
        content = head
        out += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2]), ("WARC-Truncated", "length")]
    return warc_record([*out, ("Content-Type", mime)], content)


# --- tables


class _Files:
    """Writes gzip members to files that end at FILE_BYTES or FILE_RECORDS; done: their rows."""

    def __init__(self, folder: str, ending: str, part: int) -> None:
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(folder)
        self.ending, self.part, self.seq, self.done, self.held = ending, part, 0, [], []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.held.append(member(data))
        self.size += len(self.held[-1])

    @property
    def full(self) -> bool:
        return self.size >= FILE_BYTES or len(self.held) > FILE_RECORDS

    def close(self) -> None:
        if not self.held:
            return
        path = f"{self.root}/{uuid.uuid4().hex}{self.ending}"
        with self.fs.open_output_stream(f"{path}.part") as f:
            for x in self.held:
                f.write(x)
        self.fs.move(f"{path}.part", path)
        self.done.append({"path": path, "part": self.part, "seq": self.seq, "records": len(self.held), "bytes": self.size})
        self.seq, self.held, self.size = self.seq + 1, [], 0

    def rows(self) -> pa.RecordBatch:
        out, self.done = self.done, []
        return pa.RecordBatch.from_pylist(out, schema=arrow_schema(_FILES))


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2), date: str = "20240101000000") -> DataFrame:
    """ARC files of pages (page_id, url, html), of the versions in turn; the table of files."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files = _Files(folder, ".arc.gz", TaskContext.get().partitionId())
        for batch in pieces(batches, "html"):
            for i, url, html in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version = versions[(files.part + files.seq) % len(versions)]
                if not files.held:
                    files.add(arc_version_block(version, f"{files.part}-{files.seq}.arc", date))
                payload = (html or "").encode("utf-8", "replace")
                own = b"" if i is None else PAGE_HEADER + b": %d\r\n" % i
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload)
                values = {"URL": quoted(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": str(files.size), "Filename": f"{files.part}-{files.seq}.arc"}
                files.add(arc_record(version, values, head + payload))
                if files.full:
                    files.close()
                    yield files.rows()
        files.close()
        yield files.rows()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(rows.mapInArrow(run, _FILES), folder)


def _each_file(files: DataFrame, folder: str, form: str, rows_of: Callable[[dict, bytes], list[dict]]) -> DataFrame:
    """rows_of(a row of files, the file's bytes) for each file, files dealt over all tasks."""
    ship(files.sparkSession)
    schema = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(row["path"]) as f:
                    yield pa.RecordBatch.from_pylist(rows_of(row, f.read()), schema=schema)

    # one by one: by path, what comes from a join by path would stay as it is, in one task if its rows are few
    return files.repartition(partitions(files.sparkSession)).mapInArrow(run, form)


_INDEX = "path string, part long, seq int, ix int, page_id long, rid string, url string, date string, digest string, size long"


def _index(row: dict, data: bytes) -> list[dict]:
    out = []
    for ix, (fields, content) in enumerate(read_arc(data)):
        if ix:
            head, payload = http_parts(content)
            page = header(head, PAGE_HEADER)
            rid = record_id(row["part"], row["seq"], ix, fields["URL"], digest(payload))
            out.append({k: row[k] for k in ("path", "part", "seq")} | {"ix": ix, "page_id": int(page) if page else None, "rid": rid, "url": fields["URL"], "date": warc_date(fields["Archive-date"]), "digest": digest(payload), "size": len(payload)})
    return out


def convert(arcs: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """WARC files, one of each ARC file; records whose payload an earlier chosen response has become revisits."""
    index = materialise(_each_file(arcs, folder, _INDEX, _index), folder)
    order = F.struct("page_id", "part", "seq", "ix", "rid", "url", "date")
    groups = index.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max(order).alias("to"), F.count("*").alias("n")).filter("n > 1")
    # written first, so that a payload with very many copies can be split in the join
    revisits = index.join(materialise(groups, folder), ["digest", "size"]).filter("rid <> to.rid")
    lists = revisits.groupBy("path").agg(F.collect_list(F.struct("ix", F.col("to.rid").alias("rid"), F.col("to.url").alias("url"), F.col("to.date").alias("date"))).alias("revisits"))

    def rows_of(row: dict, data: bytes) -> list[dict]:
        to = {x["ix"]: (x["rid"], x["url"], x["date"]) for x in row["revisits"] or []}
        files = _Files(folder, ".warc.gz", row["part"])
        files.seq = row["seq"]
        for ix, (fields, content) in enumerate(read_arc(data)):
            _, payload = http_parts(content)
            rid = record_id(row["part"], row["seq"], ix, fields["URL"], digest(payload))
            files.add(convert_record(fields, content, rid, to.get(ix)))
        files.close()
        return files.done

    return materialise(_each_file(arcs.join(lists, "path", "left"), folder, _FILES, rows_of), folder)


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, rid string, refers string"


def _records(_: dict, data: bytes) -> list[dict]:
    out = []
    for fields, block in read_warc(data):
        kind = fields["warc-type"]
        if kind not in ("response", "revisit", "resource"):
            continue
        head, payload = http_parts(block)
        page, said = header(head, PAGE_HEADER), fields["warc-payload-digest"].removeprefix("sha1:")
        if kind != "revisit" and digest(payload) != said:
            raise ValueError(f"payload of {fields['warc-record-id']} has another digest")
        size = int(header(head, b"Content-Length") or 0) if kind == "revisit" else len(payload)
        out.append({"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": said, "record_type": kind, "rid": fields["warc-record-id"], "refers": fields.get("warc-refers-to")})
    return out


def read_back(warcs: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page of the record that a revisit names)."""
    rows = materialise(_each_file(warcs, folder, _RECORDS, _records), folder)
    named = rows.filter("record_type <> 'revisit'").select(F.col("rid").alias("refers"), F.col("page_id").alias("refers_to"))
    first = rows.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    again = rows.filter("record_type = 'revisit'").join(named, "refers", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(out).unionByName(again.select(out))


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read again."""
    folder = folder or scratch(pages.sparkSession)
    return read_back(convert(write_arc(pages, folder), folder, least), folder)
