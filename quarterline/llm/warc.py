"""Web archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

``write_archives`` writes one WARC record per page. Of records with equal payloads the one with the
smallest id is a ``response``, the others are ``revisit`` records that refer to it and hold headers
only. Each Spark partition becomes one archive; Spark's text sink writes the frames, with an empty
skippable frame as the line separator, so archives go to any store that Spark can write.

``read_archives`` reads archives back: it loads the dictionary of the leading skippable frame, walks
the frames, decodes one frame per record and checks the version line, the mandatory headers, the
lengths of frame, block and payload, and the digests. A broken archive raises ``ValueError``.

The dictionary is fitted to the first DICTIONARY_PAGES pages of an archive; it only changes sizes.

Cases: a null html is an empty payload; empty payloads are equal to one another; rows that tie
for the smallest id are all responses; a null id is larger than any other (if all are null, all are
responses) and reads back as null; a null url leaves the target out; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.llm.common import query, shared_path, small_batches, table

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = 0x184D2A50  # the last four bits are free
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame, in characters.
SEPARATOR = "P*M\x18\0\0\0\0"
DICTIONARY_PAGES = 100
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: four digits from every five."""
    out = []
    for i in range(8):
        n = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, n_bytes, refers_to`` (null for responses)."""
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = slim.withColumns({"digest": F.sha1("html"), "n_bytes": F.octet_length("html").cast("long")})
    groups = slim.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    groups = groups.where((F.col("c") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("of"), "first")
    joined = slim.join(groups, F.col("digest") == F.col("of"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", base32(F.col("digest")).alias("digest"), "n_bytes", refers.alias("refers_to"))


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, html: str, digest: str, refers_to) -> bytes:
    """The bytes of one WARC record."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fitted_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or plain content where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        content = (b"".join(samples) or b"WARC/1.1\r\n")[:DICTIONARY_BYTES].ljust(8, b" ")
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of one archive: the dictionary's, then one for each record."""
    packer = None
    for rows in batches:
        if rows.empty:
            continue
        made = [record(*x) for x in rows.itertuples(index=False)]
        out = []
        if packer is None:
            dictionary = fitted_dictionary(made[:DICTIONARY_PAGES])
            content = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            out.append(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        yield pd.DataFrame({"value": out + [packer.compress(x) for x in made]})


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Write one archive per partition under ``path``; returns the path."""
    small_batches(pages.sparkSession, 500)
    typed = with_record_types(pages, min_bytes)
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # pandas has no long with nulls
    typed = typed.select(ids[0], "url", "html", "digest", ids[1])
    frames = typed.mapInPandas(archive_frames, "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    return path


# ---- reading -----------------------------------------------------------------------------
def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends: its block headers tell, without decoding."""
    head = bytes(data[at : at + 18])
    try:
        size, checksum = zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise ValueError(f"frame at {at}: {e}") from None
    at += size
    while True:
        _need(at + 3 <= len(data), "archive ends inside a frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * checksum
            _need(at <= len(data), "archive ends inside a frame")
            return at


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    if content[:4] == struct.pack("<I", FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
    return zstandard.ZstdCompressionDict(content)


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of every record frame of an archive."""
    data, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        _need(at + 8 <= len(data), "archive ends inside a frame header")
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            _need(at + 8 + length <= len(data), "archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC:
                _need(at == 0, "the dictionary is not in the leading frame")
                unpacker = zstandard.ZstdDecompressor(dict_data=load_dictionary(bytes(data[8 : 8 + length])))
            at += 8 + length
            continue
        _need(magic == FRAME_MAGIC, f"no frame at offset {at}")
        end = frame_end(data, at)
        try:
            yield at, unpacker.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at {at}: {e}") from None
        at = end


def _headers(raw: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        _need(bool(colon and name.strip()), f"broken header line {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """Check one record and take it apart."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    _need(version in (b"WARC/1.0", b"WARC/1.1") and bool(gap), "no WARC version line")
    h = _headers(lines)
    for name in REQUIRED:
        _need(name in h, f"header {name.decode()} is missing")
    _need(h[b"content-length"].isdigit(), "Content-Length is no number")
    length = int(h[b"content-length"])
    _need(len(rest) == length + 4 and rest.endswith(b"\r\n\r\n"), "block length differs from Content-Length")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    sent = _headers(http.partition(b"\r\n")[2]).get(b"content-length", b"")
    _need(sent.isdigit(), "the HTTP headers have no length")
    kind, digest = h[b"warc-type"].decode(), h.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    if kind == "response":
        _need(len(payload) == int(sent), "payload length differs from the HTTP header")
        _need(base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest, "payload digest differs")
    else:
        _need(kind == "revisit" and not payload and b"warc-refers-to" in h, "broken revisit record")
    return {
        "record_type": kind, "record_id": h[b"warc-record-id"].decode(), "url": h[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in h else None,
        "payload_bytes": int(sent), "payload_digest": digest, "refers_to": h[b"warc-refers-to"].decode() if b"warc-refers-to" in h else None,
        "payload": payload if kind == "response" else None,
    }


RECORD_SCHEMA = (
    "archive string, offset long, record_type string, record_id string, url string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, per_frame: int = 256) -> DataFrame:
    """All records of the archives under ``path``; without ``payloads`` that column is null."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                out = []
                for at, raw in frames(content):
                    try:
                        row = parse_record(raw)
                    except ValueError as e:
                        raise ValueError(f"{name} at {at}: {e}") from None
                    out.append({"archive": name, "offset": at, **row, **({} if payloads else {"payload": None})})
                    if len(out) == per_frame:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(records, RECORD_SCHEMA)


def page_number(name: str) -> Column:
    """The id in a record's name; null if it has none."""
    digits = F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


_B32 = " || ".join(
    f"substr('{BASE32}', CAST((CAST(('0x' || substr(h, {5 * i + 1}, 5)) AS INTEGER) >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM g"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark, sf_dir):
    path = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_path(spark, "warc"))
    records = read_archives(spark, path, payloads=False)
    return records.select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to")
    )
