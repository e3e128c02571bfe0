"""Archive files, and archives by other writers: versions, record types, HTTP messages, folded lines, digests."""

import base64
import hashlib
import struct

import zstandard

from textloom.llm.warc import DICTIONARY_MAGIC, load_archives, read_archives, save_archives, write_archives


def rec(kind, block=b"", version=b"WARC/1.0", **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:0b1a>", "WARC-Date": "2020-01-02T03:04:05Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in fields.items()}
    return version + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("latin-1" if k == "X-Latin" else "utf-8") for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive(rows, dictionary=b"", frames=()):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    out = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return out + b"".join(packer.compress(r) for r in rows) + b"".join(frames)


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"


def test_archives_of_other_writers(spark):
    said = {"Content_Type": "application/http; msgtype=response"}
    rows = [
        (rec("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"), ("warcinfo", None, None, None)),
        (rec("response", HTTP, WARC_Payload_Digest=sha1(b"<p>body</p>"), WARC_Block_Digest=sha1(HTTP), WARC_Target_URI="http://a/", **said), ("response", 11, sha1(b"<p>body</p>")[5:], None)),
        (rec("response", CHUNKED, WARC_Payload_Digest=sha1(b"abcde"), **said), ("response", 5, sha1(b"abcde")[5:], None)),
        (rec("response", CHUNKED, WARC_Payload_Digest=sha1(CHUNKED.split(b"\r\n\r\n", 1)[1]), **said), ("response", 24, sha1(CHUNKED.split(b"\r\n\r\n", 1)[1])[5:], None)),
        (rec("response", HTTP, version=b"WARC/0.18", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"<p>body</p>").hexdigest(), **said), ("response", 11, sha1(b"<p>body</p>")[5:], None)),
        (rec("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"), ("request", 0, sha1(b"")[5:], None)),
        (rec("metadata", b"via: x\r\n", version=b"WARC/1.1", WARC_Concurrent_To="<urn:uuid:1>"), ("metadata", None, None, None)),
        (rec("conversion", b"plain", WARC_Refers_To="<urn:uuid:77>", Content_Type="text/plain"), ("conversion", 5, sha1(b"plain")[5:], "<urn:uuid:77>")),
        (rec("resource", b"file", Content_Type="text/plain"), ("resource", 4, sha1(b"file")[5:], None)),
        (rec("revisit", HTTP.split(b"<")[0], WARC_Payload_Digest=sha1(b"x"), WARC_Refers_To_Target_URI="http://b/"), ("revisit", None, sha1(b"x")[5:], "http://b/")),
        (rec("continuation", b"part", WARC_Segment_Number="2", WARC_Payload_Digest=sha1(b"whole")), ("continuation", None, sha1(b"whole")[5:], None)),
        (rec("x-own", b"?", X_Latin="\xe9"), ("x-own", None, None, None)),
        (rec("resource", b"f", Content_Type="text/\r\n  plain", WARC_Type="resource"), ("resource", 1, sha1(b"f")[5:], None)),
        (rec("response", HTTP, WARC_Payload_Digest=sha1(b"other"), **said), None),
        (rec("response", HTTP, WARC_Block_Digest=sha1(b"other"), **said), None),
        (rec("revisit"), None),
        (rec("resource", b"f", Content_Length="2"), None),
    ]
    skip = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    plain, trained = archive([r for r, _ in rows], frames=[skip]), archive([r for r, _ in rows], b"WARC/1.0\r\nWARC-Type: response\r\n" * 40)
    df = spark.createDataFrame([(plain,), (trained,), (None,), (b"",)], "archive binary")
    got = read_archives(df, blocks=True).collect()
    assert len(got) == 2 * len(rows)
    for found in (got[: len(rows)], got[len(rows) :]):
        for r, (_, want) in zip(found, rows, strict=True):
            if want is None:
                assert r.error and r.record_type is None
            else:
                assert (r.error, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) == (None, *want) and r.record_id == "<urn:uuid:0b1a>" and r.name is None and r.date == "2020-01-02T03:04:05Z"


def test_files(spark, tmp_path):
    from textloom.llm.common import table

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 7}</p>" * 30) for i in range(60)] + [(None, None, None)], "page_id long, url string, html string").repartition(3)
    archives = table(write_archives(pages, archive_bytes=2000), "test-warc")
    folder = f"file://{tmp_path}/w"
    for _ in range(2):  # again: the same files
        written = save_archives(archives, folder).collect()
    files = sorted(p.name for p in (tmp_path / "w").iterdir())
    assert files == sorted(w.name for w in written) and sum(w.n_records for w in written) == 61 and len(files) > 2
    back = read_archives(load_archives(spark, folder)).collect()
    assert len(back) == 61 and all(r.error is None for r in back)
    assert {r.record_type for r in back} == {"response", "revisit"} and sum(r.record_type == "response" for r in back) == 8
