"""Archives: exact round trip, record types, and what a broken archive says."""

import base64
import hashlib
import struct

import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from quarterline.llm import warc
from quarterline.llm.common import shared_path


def one_archive(n=40):
    rows = pd.DataFrame(
        {"page_id": [str(i) for i in range(n)], "url": [f"http://x.org/{i}" for i in range(n)],
         "html": [f"<p>page {i} " + "words and more words " * 9 for i in range(n)], "digest": "", "refers_to": None}
    )
    rows["digest"] = [base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in rows["html"]]
    return b"".join(v for f in warc.archive_frames(iter([rows])) for v in f["value"])


def test_dictionary_leads_and_frames_are_one_per_record():
    content = one_archive()
    assert struct.unpack_from("<I", content)[0] == warc.DICTIONARY_MAGIC
    found = list(warc.frames(content))
    assert len(found) == 40 and all(warc.parse_record(raw)["record_type"] == "response" for _, raw in found)
    with pytest.raises(zstandard.ZstdError):  # the frames need the dictionary
        zstandard.ZstdDecompressor().decompress(content[found[3][0] : found[4][0]])


@pytest.mark.parametrize("how", ["cut", "flip", "magic", "length"])
def test_broken_archives_are_refused(how):
    content = bytearray(one_archive())
    at = [a for a, _ in warc.frames(bytes(content))][5]
    if how == "cut":
        content = content[: at + 9]
    elif how == "flip":
        content[at + 30] ^= 255
    elif how == "magic":
        content[at] ^= 1
    else:
        struct.pack_into("<I", content, 4, 1 << 31)
    with pytest.raises(ValueError):
        [warc.parse_record(raw) for _, raw in warc.frames(bytes(content))]


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"Content-Length: 5", b"Content-Length: 6"), (b"words", b"werds")])
def test_broken_records_are_refused(old, new):
    raw = next(warc.frames(one_archive()))[1]
    base = warc.parse_record(raw)
    assert base["payload"].startswith(b"<p>page 0")
    with pytest.raises(ValueError):
        broken = raw.replace(old, new) if old != b"Content-Length: 5" else raw.replace(b"Content-Length: ", b"Content-Length: 9")
        warc.parse_record(broken)


def test_round_trip(spark):
    big = 2**60 + 1
    rows = [(big, "http://a/ b\n", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (None, "v", "<p>é</p>"), (None, "w", "solo"), (8, "x", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Digest", F.lit(1))
    path = warc.write_archives(pages.repartition(3), shared_path(spark, "warc"))
    got = warc.read_archives(spark, path).withColumns({"id": warc.page_number("record_id"), "to": warc.page_number("refers_to")}).collect()
    assert sorted((r.id is None, r.id or 0, r.record_type, r.to) for r in got) == sorted(
        [(False, big, "revisit", 5), (False, 3, "response", None), (False, 4, "revisit", 3), (False, 5, "response", None),
         (False, 5, "response", None), (True, 0, "revisit", 5), (True, 0, "response", None), (False, 8, "response", None)]
    )
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {"", "<p>é</p>", "solo", "y" * 3_000_000}
    assert all(r.payload_bytes == len("<p>é</p>".encode()) for r in got if r.id in (5, big))
    small = warc.with_record_types(pages, min_bytes=5).where("page_id = 4").first()
    assert small.refers_to is None


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.write_archives(pages, shared_path(spark, "warc"))
    assert warc.read_archives(spark, path).count() == 0
