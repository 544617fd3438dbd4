r"""WARC archives: written from pages, read back by boundary-chain verification.

Writing: records with equal payloads (same length and SHA-1) of at least min_bytes are one response, that of
the largest page_id, and revisits that refer to it and carry no payload.  Records are built as DataFrame
expressions and written by Spark's text writer, whose line separator is the end of a record, so archives can
lie in any store that Spark writes to; a file holds at most FILE_RECORDS records and, however long pages are,
FILE_BYTES (or one record), which bounds what a reader holds.

Reading: every place of a file that holds the magic ``WARC/1.`` is a candidate; its header tells the offset of
its successor.  Candidates of a file meet by the file's name, and pointer jumping from the file's start keeps
the reachable ones: after k rounds the pointers span 2^k records.  Magic inside a payload is a candidate that
no chain from the start reaches.  A header may be of any length; a chain that ends before its file does is an
error, not a shorter result.

Nulls and odd rows: page_id is a whole number, any other type is an error; null html is an empty payload; a null page_id counts as smallest, and is read back as
null; rows that tie for the largest page_id are all responses; line breaks in a URL are left out of its
header; other columns are left out; an empty table gives no row; a record or a foreign file of 2 GB and more can't
be read, as Spark reads a file as one value.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path

MIN_BYTES, FILE_RECORDS, FILE_BYTES, SALTS = 0, 1024, 256 << 20, 16
CRLF, MAGIC = "\r\n", "WARC/1.1"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_READ = {b"content-length", b"warc-type", b"warc-payload-length", b"warc-payload-digest", b"warc-record-id", b"warc-refers-to", b"warc-target-uri"}
FIELDS = "file string, at bigint, next bigint, size bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def base32(hexadecimal: Column) -> Column:
    """Base 32 of a SHA-1 in hex: 5 hex digits are 4 letters."""
    parts = []
    for k in range(8):
        v = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """record (string, without its end) of each page (page_id, url, html)."""
    if not isinstance(kind := pages.schema["page_id"].dataType, T.IntegralType):
        raise TypeError(f"page_id is a whole number, not {kind.simpleString()}: records name pages by it")
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    same = p.groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= min_bytes))
    # each group stands with every salt, so pages of one payload spread over SALTS tasks
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(same, ["digest", "bytes", "salt"], "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    header = [
        F.lit(MAGIC),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("largest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return p.select(F.concat(F.concat_ws(CRLF, *header), F.lit(CRLF + CRLF), block).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, compression: str = "gzip") -> None:
    largest = pages.agg(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    most = max(1, min(FILE_RECORDS, FILE_BYTES // (largest + 1024)))
    records(pages, min_bytes).write.option("lineSep", CRLF + CRLF).option("compression", compression).option("maxRecordsPerFile", most).text(path)


def inflate(content: bytes) -> bytes:
    """Plain bytes of a file that may be gzip, in one member or many."""
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join([*out, content])


def candidates(data: bytes):
    """(offset, successor, header, payload) at each magic of a file.

    The header's end is the first blank line after the magic, however far.  Magics with the same end share their
    later lines and their block, so these are read once, from the last magic on.
    """
    starts, end = [(m.start(), m.end()) for m in _START.finditer(data)], -1
    groups = []
    for at, line in starts:
        if not groups or end < line - 2:
            end = data.find(b"\r\n\r\n", line - 2)
            if end < 0:
                break
            groups.append((end, []))
        groups[-1][1].append((at, line))
    for end, magics in groups:
        header, upto, found = {}, end, []
        for at, line in reversed(magics):
            own = {}
            for text in data[line:upto].split(b"\r\n"):
                k, _, v = text.partition(b":")
                if (k := k.strip().lower()) in _READ:
                    own[k] = v.strip().decode("utf-8", "replace")
            header, upto = own | header, line
            found.append((at, header))
        length = header.get(b"content-length", "")
        if not length.isdecimal():
            continue
        stop = end + 4 + int(length)
        if data[stop : stop + 4] == b"\r\n\r\n":
            block = data[end + 4 : stop]
            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            for at, header in reversed(found):
                if b"content-length" in header:
                    yield at, stop + 4, header, payload


def _page(name: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping."""
    n = len(at)
    order = np.argsort(at, kind="stable")
    place = np.minimum(np.searchsorted(at[order], successor), n - 1)
    jump = np.append(np.where(at[order][place] == successor, place, n), n)
    seen = np.append(at[order] == 0, False)
    for _ in range(n.bit_length() + 1):
        seen[jump[seen]] = True
        jump = jump[jump]
    out = np.zeros(n, bool)
    out[order] = seen[:n]
    return out


def read_archives(spark, path: str) -> DataFrame:
    """The records of the archives at path that chains from the files' starts reach."""

    def scan(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = inflate(content.as_py())
                rows, last, sha1 = [], None, ""
                for at, stop, h, payload in candidates(data):
                    kind = h.get(b"warc-type", "")
                    if kind == "revisit":
                        size, digest = h.get(b"warc-payload-length", ""), h.get(b"warc-payload-digest", "").rpartition(":")[2]
                        size = int(size) if size.isdecimal() else None
                    else:
                        if payload is not last:
                            last, sha1 = payload, base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        size, digest = len(payload), sha1
                    rows.append((name, at, stop, len(data), _page(h.get(b"warc-record-id")), size, digest, kind, _page(h.get(b"warc-refers-to")), h.get(b"warc-target-uri")))
                if data and not rows:
                    raise ValueError(f"{name}: no record in {len(data)} bytes")
                types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [f.split()[0] for f in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def chain(table: pa.Table) -> pa.Table:
        successor = table.column("next").to_numpy()
        on = reachable(table.column("at").to_numpy(), successor)
        ends, size = int(successor[on].max(initial=0)), table.column("size")[0].as_py()
        if ends != size:
            raise ValueError(f"{table.column('file')[0]}: the chain of records ends at {ends} of {size} bytes")
        return table.filter(pa.array(on))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    found = files.mapInArrow(scan, FIELDS)
    return found.groupBy("file").applyInArrow(chain, FIELDS)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = "('0x' || substr(h, {0}, 5))::INT"
_LETTERS = " || ".join(f"substr('{_ALPHABET}', (({_BITS.format(5 * k + 1)} >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to
FROM g
"""
