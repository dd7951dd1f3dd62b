"""WARC archives, index first.

Writing: every task writes its records as gzip members into archives of its own in the shared folder and returns an index
row (file, offset, length, URL, digest) per record. An archive's name is new for every task attempt and is known by its
index rows alone, which Spark keeps of the attempt that succeeded; what a lost attempt wrote is never read.
Reading: the selected index rows are sorted by file and offset, near ranges are joined into one read, and the records are
cut out of it, parsed and checked against their digests.

Of records with equal payloads, the one with the largest id is a response, the others are revisits that refer to it and
keep only the HTTP header of their payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import attach, new_path, stash
from wattline.llm.registry import register, table

#: An archive is closed after this many bytes.
ARCHIVE_BYTES = 64_000_000
#: Ranges of one archive that lie closer than this are read at once, up to the second number of bytes.
GAP, READ_BYTES = 65_536, 8_000_000
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:wattline:page:"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. Control characters in the URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:wattline:unknown")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, payload length as its HTTP header says, and the payload (empty for revisits) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != said or f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, said, payload


def _page_of(name: str | None) -> int | None:
    number = name[len(_ID) + 1 : -1] if name else ""
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into ``folder`` (a URI that all tasks reach) and return the stored index.

    Payload: the html in UTF-8 (null: empty). Payloads smaller than ``least_bytes`` are never revisits. Rows that repeat
    the largest id of equal payloads are all responses; a row without an id never has others refer to it. An empty table
    gives an empty index; other columns are not read.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    equal = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    typed = attach(rows, equal, ["sha1"], F.struct("page_id", "url"))
    refers = F.when((F.octet_length("payload") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    typed = typed.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        try:
            for frame in frames:
                index = []
                for page, url, payload, sha1, refers_to in frame.astype({"page_id": "Int64", "refers_to": "Int64"}).itertuples(index=False, name=None):
                    page, refers_to = (None if pd.isna(x) else int(x) for x in (page, refers_to))
                    if out is not None and at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(posixpath.join(base, name), compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = gzip.compress(make_record(page, url, bytes(payload), digest, refers_to), 6, mtime=0)
                    out.write(member)
                    index.append((page, url, name, at, len(member), digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                done = pd.DataFrame(index, columns=["page_id", "url", "file", "offset", "length", "digest", "record_type", "refers_to"])
                yield done.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return stash(typed.mapInPandas(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the given index rows: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    ``index`` may be any selection of the rows that ``write_archives`` returned. Everything comes from the records
    themselves; a damaged record fails the read. ``payload`` is null for revisits.
    """
    places = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        """File, begin and end of each joined read, and the records in it."""
        name, begin, end, held = None, 0, 0, []
        for frame in frames:
            for f, at, n in frame.itertuples(index=False, name=None):
                if held and (f != name or at > end + GAP or at + n - begin > READ_BYTES):
                    yield name, begin, end, held
                    held = []
                if not held:
                    name, begin = f, at
                held.append((at, n))
                end = at + n
        if held:
            yield name, begin, end, held

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for name, begin, end, held in ranges(frames):
            if name != opened:
                if source is not None:
                    source.close()
                opened, source = name, store.open_input_file(posixpath.join(base, name))
            data = source.read_at(end - begin, begin)
            found = []
            for at, n in held:
                fields, size, payload = parse_record(gzip.decompress(data[at - begin : at - begin + n]))
                kind = fields["WARC-Type"]
                row = (_page_of(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, _page_of(fields.get("WARC-Refers-To")))
                found.append((*row, payload.decode("utf-8", "replace") if kind == "response" else None) if with_payload else row)
            out = pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    return places.mapInPandas(read, schema)


@register("op5_warc_index_first")
def op5_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder)
