import hashlib
import io
import random

import zstandard

from quillstream.llm import warc as A
from tests.llm.helpers import words

SCHEMA = "page_id bigint, url string, html string, HTML string, payload string, refers_to int"


def brute(rows):
    newest = {}
    for i, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = newest[h or ""]
        again = len(raw) >= 1000 and top >= 0 and i != top
        out.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(top if again else None)))
    return sorted(out)


def test_round_trip(spark):
    rng = random.Random(4)
    long, short = " ".join(words(rng, 400)), "<p>short</p>"
    rows = [(k, f"http://h/{k}\r\nX: y%", f"<html>{' '.join(words(rng, 80))} é漢</html>") for k in range(60)]
    rows += [(100, None, long), (101, "u", long), (102, "u", long), (102, "u", long), (None, "u", long), (103, "u", short), (104, "u", short), (105, "u", None), (106, "u", ""), (107, "u", "é" * 500), (108, "u", "é" * 500), (109, "u", long * 500)]
    df = spark.createDataFrame([(*r, "c", "d", 1) for r in rows], SCHEMA)
    for size in (A.ARCHIVE_BYTES, 2000):
        got = A.archive_pages(df, archive_bytes=size).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(rows)
        texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
        assert texts[109] == long * 500 and texts[3] == rows[3][2]
        assert {r.page_id: r.url for r in got}[5] == rows[5][1]


def test_empty_table(spark):
    assert A.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dictionary_leads_and_each_record_stands_alone():
    rng = random.Random(5)
    common = " ".join(words(rng, 300))
    records = [A.record(k, "u", "response", None, "0" * 40, 3, (common + str(k)).encode(), "2020-01-01T00:00:00Z") for k in range(300)]
    frames = list(A.compress(records))
    assert frames[0][:4] == A.SKIPPABLE.to_bytes(4, "little")
    raw = frames[0][8:]
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert codec.decompress(frames[201]) == records[200]
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert sum(map(len, frames)) < plain / 2
    back = list(A.read_archive(io.BytesIO(b"".join(frames))))
    assert len(back) == 300 and back[7][1] == (common + "7").encode()


def test_records_have_what_the_format_demands(spark, tmp_path):
    long = "x" * 2000
    rows = [(7, "http://a/", long), (7, "http://a/", long), (None, "http://n/", long), (None, None, "y"), (3, "http://b/", long)]
    A.archive_pages(spark.createDataFrame([(*r, "c", "d", 1) for r in rows], SCHEMA), str(tmp_path / "w")).collect()
    found = []
    for path in (tmp_path / "w").glob("*.warc.zst"):
        with path.open("rb") as f:
            found += [fields for fields, _ in A.read_archive(f)]
    assert len(found) == 5 and len({f["WARC-Record-ID"] for f in found}) == 5
    for f in found:
        assert f["WARC-Record-ID"].startswith("<urn:uuid:") and len(f["WARC-Date"]) == 20 and f["Content-Type"] == "application/http; msgtype=response"
        if f["WARC-Type"] == "revisit":
            assert f["WARC-Refers-To-Target-URI"] == "http://a/" and f["WARC-Refers-To-Date"] == f["WARC-Date"]
    assert sorted(f["WARC-Type"] for f in found) == ["response"] * 3 + ["revisit"] * 2
