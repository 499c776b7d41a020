"""Legacy web archives: ARC files of versions 1 and 2 are written, parsed and converted to WARC.

ARC records are header lines, whose fields depend on the version block before them, and as many bytes as the
line declares. ``read_arc`` parses them; ``to_warc`` makes the equivalent WARC records: identifiers derived from
the record, ISO timestamps, record types, block and payload digests, and revisits for repeated payloads;
``read_warc`` reads those back.

Archives are written by Spark's text writer, one record per row with the format's own separator, and read as
binary files, so any file system that Spark knows will do. File sizes are bounded by the number of parts, which
follows the bytes. Equal payloads are found by digest: sums before the shuffle, digests that very many records
share broadcast (at most ``HOT_GROUPS`` of them), other records joined by digest. Pages are dealt over the parts by
their number in the scan too, so rows that are equal, or have neither id nor url, do not gather in one file.

Defined results: a null payload is empty, a null url is ``about:blank`` (white space and controls in a url are
percent-encoded); a record without id has a null id, and counts as smaller than all others. Repeated rows are
separate records with one identifier. An empty table writes version blocks only and reads back empty. A header
line that cannot be parsed is skipped up to the next line; a record cut off by the end of its file is kept with
what is there and marked truncated. HTTP heads are bytes and pass through in any encoding. Ids are whole numbers;
an id column of another kind is refused. A page whose url looks like a version block's is an ordinary record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from affinis.llm.store import settle

PART_BYTES = 4 << 20
MIN_REVISIT = 1000
HOT_GROUPS = 1000
BATCH_BYTES = 8 << 20
DATE = "20240101000000"
#: Fixed values of the ARC format: fields of a header line by version, the last one the length.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value of the ARC format: a version block is its version, a flag and who wrote it, then the names of the fields.
VERSION_BLOCK = re.compile(rb"(\d+) \d+ [^\n]*\nURL ")
#: Fixed value of the WARC format: what a revisit by equal digest is called.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Writing ARC

def _http(status: str = "200 OK"):
    return F.concat(
        F.lit(f"HTTP/1.0 {status}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string"))).otherwise(""),
        F.lit("\r\n\r\n"))


def _write(rows: DataFrame, path: str, separator: str) -> None:
    rows.select("value").write.option("lineSep", separator).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              part_bytes: int = PART_BYTES) -> None:
    """ARC files of ``pages``; parts alternate between the two versions."""
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.monotonically_increasing_id().alias("row_no"))
    parts = 1 + (rows.agg(F.sum(F.octet_length("payload") + 300)).first()[0] or 0) // part_bytes
    url = F.col("url")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    block = F.concat(_http(), F.col("payload"))
    head = [F.when(url == "", "about:blank").otherwise(url), F.lit("0.0.0.0"), F.lit(DATE), F.lit("text/html")]
    length = F.octet_length("block").cast("string")
    line = F.when(F.col("part") % 2 == 0, F.concat_ws(" ", *head, length)).otherwise(F.concat_ws(
        " ", *head, F.lit("200"), F.concat(F.lit("sha1:"), F.sha1("payload")), F.lit("-"), F.lit("0"),
        F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".arc")), length))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url", "row_no"), F.lit(parts)).cast("int")).withColumn("block", block)
    rows = rows.select("part", F.lit(1).alias("kind"), "page_id", F.concat(line, F.lit("\n"), F.col("block")).alias("value"))

    def version(n: int):
        """The version block: a record about the file, which names the fields of those after it."""
        body = f"{n} 0 affinis\n{FIELDS[n]}\n"
        name = F.concat(F.lit("filedesc://part-"), F.col("part").cast("string"), F.lit(".arc"))
        extra = [] if n == 1 else ["200", "-", "-", "0", "-"]
        return F.concat(F.concat_ws(" ", name, *map(F.lit, ["0.0.0.0", DATE, "text/plain", *extra, str(len(body))])), F.lit("\n" + body))

    blocks = pages.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).select(
        "part", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"),
        F.when(F.col("part") % 2 == 0, version(1)).otherwise(version(2)).alias("value"))
    ordered = rows.unionByName(blocks).repartition(parts, "part").sortWithinPartitions("part", "kind", "page_id")
    _write(ordered, path, "\n")


# Reading ARC

def _unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header fields, content and whether the file ended early, of every record but the version blocks."""
    at, names = 0, FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").strip("\r")
        at = end + 1
        if not line.strip():
            continue
        # The block is read before its line can be: the version decides how many fields the line has.
        version = line.startswith("filedesc://") and VERSION_BLOCK.match(data, at)
        if version:
            names = FIELDS[2 if version[1] == b"2" else 1].split()
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            continue
        length = int(values[-1])
        if not version:
            yield dict(zip(names, values)), data[at: at + length], at + length > len(data)
        at += length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload. Content without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4:])


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()),
    ("truncated", pa.bool_()), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string())])
_RECORD_DDL = ("page_id long, url string, ip string, date string, mime string, truncated boolean, http binary, payload binary, "
               "payload_bytes long, digest string, block_digest string, head_digest string")


def _batched(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column("content"):
            yield _unpacked(content.as_py())


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for data in _files(batches):
            for fields, block, cut in parse_arc(data):
                head, payload = split_http(block)
                yield (_number(_field(head, b"X-Page-Id")), fields["URL"], fields["IP-address"], fields["Archive-date"],
                       fields["Content-type"], cut, head, payload, len(payload), _sha1(payload),
                       _sha1(block), _sha1(head))
    return _batched(rows(), _RECORD, lambda r: r[8] + 500)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record with its head, payload and digests."""
    return _archives(spark, path).mapInArrow(_arc_rows, _RECORD_DDL)


# Writing WARC

def _with_reference(records: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``top``: the largest id with the same payload, where two records of ``min_bytes`` or more share it."""
    sums = records.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("digest").alias("its_digest")).agg(
        F.count("*").alias("n"), F.max("page_id").alias("top"))
    sums = settle(sums.where("n > 1"), "payload-groups")
    bound = (sums.agg(F.sum("n")).first()[0] or 0) // HOT_GROUPS
    # At most HOT_GROUPS digests can have more records than that share of them.
    hot = sums.where(F.col("n") > bound).select(F.col("its_digest").alias("hot_digest"), F.col("top").alias("hot_top"))
    cold = sums.where(F.col("n") <= bound).select("its_digest", "top")
    joined = records.join(F.broadcast(hot), (F.col("digest") == F.col("hot_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    settled = F.col("hot_digest").isNotNull() | (F.col("payload_bytes") < min_bytes)
    # Records that need no join any more are spread by id.
    joined = joined.withColumn("key", F.when(settled, F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url")))).otherwise(F.col("digest")))
    joined = joined.join(cold, F.col("key") == F.col("its_digest"), "left")
    return joined.withColumn("top", F.coalesce("hot_top", "top")).drop("hot_digest", "hot_top", "key", "its_digest")


def _identifier(page_id):
    """A record's identifier, derived from what it archives, so that reruns agree."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.col("digest")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def to_warc(records: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """WARC files of ARC records; later copies of a payload become revisits of the one with the largest id."""
    marked = _with_reference(records, min_bytes)
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    headless = F.octet_length("http") == 0
    block = F.when(revisit, F.col("http")).otherwise(F.concat(F.col("http"), F.col("payload")))
    d = F.col("date")
    iso = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"),
                   F.substring(d, 9, 2), F.lit(":"), F.substring(d, 11, 2), F.lit(":"), F.substring(d, 13, 2), F.lit("Z"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise(F.when(headless, "resource").otherwise("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _identifier(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), iso), F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-IP-Address: "), F.col("ip")),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: "), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _identifier(F.col("top")),
                                 F.lit("\r\nX-Refers-To-Page-Id: "), F.col("top").cast("string"))),
        F.when(F.col("truncated"), "WARC-Truncated: length"),
        F.concat(F.lit("Content-Type: "), F.when(headless, F.col("mime")).otherwise("application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    _write(marked.select(F.concat(head, F.lit("\r\n\r\n"), block.cast("string")).alias("value")), path, "\r\n\r\n")


# Reading WARC

def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of every record."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        length = _number(_field(data[at:end], b"Content-Length")) or 0
        yield data[at: end], data[end + 4: end + 4 + length]
        at = end + 4 + length


_BACK = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_BACK_DDL = ("page_id long, url string, date string, record_type string, record_id string, payload_bytes long, payload_digest string, "
             "sound boolean, refers_to long, payload binary")


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for data in _files(batches):
            for head, block in parse_warc(data):
                http, payload = split_http(block)
                kind, digest = _field(head, b"WARC-Type"), _field(head, b"WARC-Payload-Digest")
                revisit = kind == "revisit"
                yield (_number(_field(http, b"X-Page-Id")), _field(head, b"WARC-Target-URI"), _field(head, b"WARC-Date"), kind,
                       _field(head, b"WARC-Record-ID"), _number(_field(http, b"Content-Length")) if revisit else len(payload),
                       base64.b32decode(digest.removeprefix("sha1:")).hex(), _sha1(block) == _field(head, b"WARC-Block-Digest"),
                       _number(_field(head, b"X-Refers-To-Page-Id")), None if revisit else payload)
    return _batched(rows(), _BACK, lambda r: r[5] + 500)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record; ``sound`` tells whether the block has the digest its head gives."""
    return _archives(spark, path).mapInArrow(_warc_rows, _BACK_DDL)
