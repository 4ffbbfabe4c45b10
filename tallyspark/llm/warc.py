"""WARC archives: an index first, then coalesced range reads of what was selected.

write() makes one archive file of every partition of pages, each record a gzip member of its own, and returns
the index: file, offset, length, URL and digest of each record. index_files() builds the same index from
archives that exist already. read() takes index rows, sorts them by file and offset, merges ranges that lie
within a small gap to single reads, and gives the records back, each verified against its digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parked, pick, scratch_path

#: Ranges at most so far apart are read at once, and what lies between is thrown away.
MAX_GAP = 64 << 10
#: A read ends at this size; a longer record is a read of its own.
MAX_READ = 8 << 20

INDEX = "file string, offset long, length long, record_id long, url string, digest string, warc_type string, warc_id string"
_KINDS = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "record_id": pa.int64(), "url": pa.string(), "digest": pa.string(), "warc_type": pa.string(), "warc_id": pa.string()}
_OWN_ID = re.compile(r"<urn:page:(-?\d*)>")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _record(record_id: int | None, url: str | None, html: str | None) -> tuple[bytes, str]:
    """A record as a gzip member, and its digest. A null URL has no target line, a null page a type of its own."""
    body = (html or "").encode()
    digest = hashlib.sha256(body).hexdigest()
    head = [b"WARC/1.0", b"WARC-Type: " + (b"resource" if html is not None else b"metadata"), f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%").encode())
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), f"Content-Length: {len(body)}".encode()]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush(), digest


def split_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, their names in lower case, and block of one record, whoever wrote it. White space around values doesn't count, a line that begins with some
    continues the one before; of repeated headers the first counts. A block without a valid Content-Length is all that follows."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    size = headers.get("content-length", "")
    return headers, rest[: int(size)] if size.isdigit() else rest


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzipped record."""
    return split_record(zlib.decompress(member, 31))


def _page(headers: dict[str, str], block: bytes) -> str | None:
    """The page of a record: a resource's block, what follows the HTTP headers of a response; other records have none. Bytes that are no UTF-8 are replaced."""
    kind = headers.get("warc-type", "")
    if kind == "response" and block.startswith(b"HTTP/"):
        block = block.partition(b"\r\n\r\n")[2]
    return block.decode("utf-8", "replace") if kind in ("resource", "response") else None


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to archives in folder, a file to each partition, and returns their index, as a table in the scratch folder.

    Nulls in any column come back as nulls, empty pages as empty ones; repeated rows make repeated records. Pages are written whole, however long. Other columns, of whatever
    name, are left out; an empty table has an empty index. Ids are whole numbers. A task that runs again writes a file of its own, which alone its index rows name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            if out is None and batch.num_rows:
                system, path = _open(uri)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            rows: list[tuple] = []
            for record_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                member, digest = _record(record_id, url, html)
                out.write(member)
                rows.append((uri, at, len(member), record_id, url, digest, "resource" if html is not None else "metadata", None))
                at += len(member)
            yield _index_batch(rows)
        if out is not None:
            out.close()

    return parked(pick(pages, record_id=id_col, url=url_col, html=html_col).select(F.col("record_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, INDEX), "warc-index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS.values())], names=list(_KINDS))


def index_files(files: DataFrame) -> DataFrame:
    """The index of the gzipped archives named in the column `file`, write()'s or others': each file is read through once, member by member, in pieces.

    Records of all types are indexed. record_id is null but for write()'s records, warc_id is the record's own name; digest is the block's SHA-256. A file that breaks off
    in a record is indexed up to there; a null file name has no rows, nor has an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in filter(None, batch.column(0).to_pylist()):
                system, path = _open(uri)
                with system.open_input_stream(path, compression=None) as source:
                    rows, at, rest = [], 0, b""
                    while True:
                        press, raw, length = zlib.decompressobj(31), [], 0
                        while not press.eof:
                            piece, rest = rest or source.read(1 << 16), b""
                            if not piece:
                                break
                            raw.append(press.decompress(piece))
                            rest = press.unused_data
                            length += len(piece) - len(rest)
                        if not press.eof:
                            break
                        headers, block = split_record(b"".join(raw))
                        name = headers.get("warc-record-id")
                        own = _OWN_ID.fullmatch(name or "")
                        rows.append((uri, at, length, int(own[1]) if own and own[1] else None, headers.get("warc-target-uri"), hashlib.sha256(block).hexdigest(), headers.get("warc-type"), None if own else name))
                        at += length
                        if len(rows) == 4096:
                            yield _index_batch(rows)
                            rows = []
                    yield _index_batch(rows)

    return files.select("file").mapInArrow(run, INDEX)


def read(index: DataFrame, *, max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> DataFrame:
    """(record_id, url, digest, html, verified) of every index row.

    Rows are sorted by file and offset and joined to reads: a new one begins where a gap exceeds max_gap or where the
    file's next stretch of max_read bytes begins. Rows named twice are given twice. A record whose block doesn't have its digest, or a null one, is given as not verified. An empty
    index gives an empty table; records are read whole, however long. Other columns of the index are ignored.
    """
    index = index.select("file", "offset", "length", "record_id", "url", "digest")
    reach = "PARTITION BY file ORDER BY offset, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    sorted_rows = index.selectExpr("*", f"CASE WHEN offset <= max(offset + length) OVER ({reach}) + {max_gap} AND offset div {max_read} = lag(offset) OVER (PARTITION BY file ORDER BY offset, length) div {max_read} THEN 0 ELSE 1 END AS fresh")
    reads = sorted_rows.selectExpr("*", "sum(fresh) OVER (PARTITION BY file ORDER BY offset, length ROWS UNBOUNDED PRECEDING) AS part").groupBy("file", "part")
    reads = reads.agg(F.min("offset").alias("begin"), F.max(F.expr("offset + length")).alias("end"), F.collect_list(F.struct("offset", "length", "record_id", "url", "digest")).alias("rows"))
    reads = reads.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "part").select("file", "begin", "end", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source = None, None
        for batch in batches:
            for uri, begin, end, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != now:
                    if source is not None:
                        source.close()
                    system, path = _open(uri)
                    now, source = uri, system.open_input_file(path)
                block = memoryview(source.read_at(end - begin, begin))
                out: list[tuple] = []
                for r in rows:
                    headers, body = parse(block[r["offset"] - begin : r["offset"] - begin + r["length"]])
                    out.append((r["record_id"], r["url"], r["digest"], _page(headers, body), hashlib.sha256(body).hexdigest() == r["digest"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["record_id", "url", "digest", "html", "verified"])
        if source is not None:
            source.close()

    return reads.mapInArrow(run, "record_id long, url string, digest string, html string, verified boolean")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages written to archives in the scratch folder, indexed, and every record read back by its index row."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc"), id_col, url_col, html_col))
