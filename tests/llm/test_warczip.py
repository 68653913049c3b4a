import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veridoc.llm import warczip


def slow(rows):
    payload = [(h or "").encode() for _, _, h in rows]
    out = []
    for (page, _, _), p in zip(rows, payload):
        same = [r[0] for r, q in zip(rows, payload) if q == p and r[0] is not None]
        first = min(same) if same and len(p) >= 100 else None
        revisit = first is not None and page != first
        out.append((page, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", "é" * (i % 7) * 30) for i in range(60)] + [(70, None, None), (71, "http://a b\r\nX: y", ""), (5, "u", "same" * 40), (5, "u", "same" * 40), (3, "u", "same" * 40), (9, "u", "same" * 40), (None, "u", "same" * 40), (None, None, "only null" * 30), (80, "u", "long " * 200_000)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_query_equals_brute_force(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "payload", "first", "file")})
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warczip.op5_warc_zip(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(rows)


def test_payloads_come_back(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = warczip.archive(df, payload=True).filter("record_type = 'response'").collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got) and len(got) > 20


@pytest.mark.parametrize("limit", [1 << 40, 10])
def test_directories_of_both_kinds(monkeypatch, limit):
    """A small limit makes zipfile write ZIP64 records and a ZIP64 directory."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2 if limit == 10 else 65535)
    out = io.BytesIO()
    records = [("response", warczip.make_record(i, "u", b"x" * i * 50, "d", None)) for i in range(20)]
    warczip.write_package(out, iter(records))
    data = out.getvalue()
    assert (b"PK\x06\x07" in data) == (limit == 10)
    p = warczip.Package(io.BytesIO(data), len(data))
    assert p.stored(warczip.INDEX) == zipfile.ZipFile(io.BytesIO(data)).read(warczip.INDEX)
    assert p.stored(warczip.DATA) == zipfile.ZipFile(io.BytesIO(data)).read(warczip.DATA)
    assert set(p.members) == {warczip.DATA, warczip.INDEX, warczip.ABOUT}


def test_bad_packages_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "text")
    with pytest.raises(ValueError):
        warczip.Package(io.BytesIO(out.getvalue()), len(out.getvalue())).stored("a")
    with pytest.raises(ValueError):
        warczip.Package(io.BytesIO(b"no zip"), 6)
    with pytest.raises(ValueError):
        warczip.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
