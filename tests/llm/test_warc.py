import glob
import gzip
import hashlib
import random

import pytest

from ripplegraph.llm import warc as W


def brute(rows, least=100):
    first = {}
    for page, _, html in rows:
        h = (html or "").encode()
        if len(h) >= least and page is not None:
            first[h] = min(first.get(h, page), page)
    out = []
    for page, _, html in rows:
        h = (html or "").encode()
        again = h in first and page != first[h]
        out.append((page, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None, None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("html", "url", "page_id", "'d' as digest", "1 as first", "2 as n", "3 as _cell").repartition(3)


ROWS = (
    [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(120)]
    + [(1000 + i, "http://copies", "same page é " * 40) for i in range(30)]
    + [(2000 + i % 5, None, "repeated rows " * 3000) for i in range(15)]
    + [(3, "u", None), (4, "", ""), (5, "short", "x"), (6, "short", "x"), (None, "n", "null id " * 30), (None, "m", "null id " * 30), (None, "c", "same page é " * 40)]
    + [(-7, "http://x/\r\nWARC-Type: revisit\n a", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 900), (8000, "é/ü", "日本" * 30000), (8001, "z", "0\r\n\r\n" * 7000)]
)


def test_round_trip_equals_brute_force(spark, tmp_path, monkeypatch):
    got = W.archived_pages(pages(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)
    # payloads themselves, over many small archives
    path = f"file://{tmp_path}/warc"
    W.write_archives(pages(spark, ROWS), path, segment=1000, archive=5000)
    assert len(glob.glob(f"{tmp_path}/warc/part-*")) > 20
    records = W.read_archives(spark, path)
    assert sorted(map(tuple, W.page_digests(records).collect()), key=str) == brute(ROWS)
    own = [(r.page_id, bytes(r.payload).decode()) for r in records.where("record_type = 'response'").collect()]
    assert len(own) == sum(x[3] == "response" for x in brute(ROWS))
    assert set(own) <= {(p, h or "") for p, _, h in ROWS}
    urls = {r.url for r in records.where("page_id = -7").collect()}
    assert urls == {"http://x/%0D%0AWARC-Type:%20revisit%0A%20a"}


def test_empty_table(spark):
    assert W.archived_pages(pages(spark, ROWS).limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunks_read_back(size):
    r = random.Random(1)
    for n in (0, 1, 6, 7, 8, 5000):
        payload = bytes(r.randrange(256) for _ in range(n))
        assert W.dechunked(W.chunked(payload, size)) == payload
    assert W.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab\r\n0\r\n\r\n", b"x\r\n", b"3\r\nabc\r\n", b"0\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            W.dechunked(broken)


def test_what_does_not_hold_is_reported(spark, tmp_path):
    html = "long payload " * 500
    digest = hashlib.sha256(html.encode()).hexdigest()
    make = lambda page: list(W.page_records(page, "u", digest, html.encode(), None, "d", 2000))
    good, gap, short, twice, bad = (make(i) for i in range(5))
    other = list(W.page_records(9, "u", "0" * 64, b"x", None, "d", 2000))
    lost = list(W.page_records(10, "u", digest, b"", 77, "d", 2000))
    broken = W.record({"WARC-Type": "response", "WARC-Record-ID": "<x>", "X-Page-ID": 11}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n")
    plain = W.record({"WARC-Type": "response", "WARC-Record-ID": "<y>", "X-Page-ID": 12, "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"abc").hexdigest()}, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")
    files = [good[::-1] + gap[:1] + gap[2:], short[:-1] + twice + twice, [x.replace(b"Total-Length: ", b"Total-Length: 1") for x in bad], [*other, *lost, broken, plain]]
    for i, f in enumerate(files):
        data = W._END.join(f) + W._END
        (tmp_path / f"{i}.warc").write_bytes(gzip.compress(data) if i else data)
    (tmp_path / "cut.warc").write_bytes((W._END.join([plain, plain]) + W._END)[:-9])
    (tmp_path / "none.warc").write_bytes(b"not an archive")
    got = W.page_digests(W.read_archives(spark, f"file://{tmp_path}")).collect()
    found = sorted((str((r.page_id, r.payload_bytes, r.problem)) for r in got))
    n = len(html.encode())
    want = [(0, n, None), (1, None, "missing segment"), (2, None, "segments of another length"), (3, n, None), (3, n, None), (4, None, "segments of another length")]
    want += [(9, 1, "payload of another digest"), (10, None, "refers to nothing"), (11, None, "no chunk size"), (12, 3, None), (12, 3, None), (12, None, "cut short"), (None, None, "no record")]
    assert found == sorted(map(str, want))
