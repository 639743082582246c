import gzip
import io

import pytest

from lexigrid.llm import warc as W

FIELDS = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, content_type string, payload binary, truncated boolean, capture_id string, via string, n int"


def records(spark, rows):
    return spark.createDataFrame([(i, t, c, "http://x", "2024", "text/plain", None if p is None else bytearray(p), False, "z", "v", 1) for i, t, c, p in rows], FIELDS)


def told(df):
    return {r.capture_id: (None if r.response.payload is None else bytes(r.response.payload), [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in df.collect()}


def test_links_in_every_direction(spark):
    got = W.assemble(
        records(
            spark,
            [
                ("r1", "response", [], b"one"), ("q1", "request", ["r1"], b"ask"), ("m1", "metadata", ["q1"], b"meta"),
                ("r2", "response", ["q2", "m2"], b"two"), ("q2", "request", None, b""), ("m2", "metadata", [], None),
                ("r3", "response", [], b"alone"), ("q9", "request", ["gone"], b"x"), ("i", "warcinfo", ["r3"], b"i"),
                ("q3", "request", ["m3"], b"x"), ("r4", "response", ["q4"], None), ("q4", "request", ["r4", None, "r3"], b"both"), (None, "request", ["r1"], b"no id"), ("m4", "metadata", ["q4"], b""),
            ],
        )
    )
    assert told(got) == {"r1": (b"one", ["q1"], ["m1"]), "r2": (b"two", ["q2"], ["m2"]), "r3": (b"alone", ["q4"], ["m4"]), "r4": (None, ["q4"], ["m4"])}


def test_repeated_rows_and_ids(spark):
    got = W.assemble(records(spark, [("r", "response", [], b"b"), ("r", "response", [], b"a"), ("r", "response", [], b"a"), ("q", "request", ["r"], b"x"), ("q", "request", ["r"], b"x")]))
    assert told(got) == {"r": (b"a", ["q"], [])}


def test_empty_table(spark):
    assert W.assemble(records(spark, [])).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_round_trip_of_pages(spark, tmp_path, zipped):
    rows = [(1, "http://a.example/x", "<p>é 漢</p>\r\n\r\nWARC/1.1 inside"), (2, None, ""), (3, "http://b.example", None), (4, "http://c.example/", "y" * 3_000_000), (None, "http://d.example", "z"), (5, "u", "WARC/1.0\r\n")]
    pages = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "page_id long, url string, html string, record_id string, type string")
    path = f"file://{tmp_path}/w"
    W.write_records(W.from_pages(pages), path, gzip=zipped)
    got = told(W.assemble(W.read_records(spark, path)))
    assert told(W.assemble_files(spark, path)) == got
    assert set(got) == {f"<urn:page:response:{i}>" for i in range(1, 6)}
    for i, _, html in rows:
        if i is not None:
            body, asks, meta = got[f"<urn:page:response:{i}>"]
            assert body.endswith(("\r\n\r\n" + (html or "")).encode()) and asks == [f"<urn:page:request:{i}>"] and meta == [f"<urn:page:metadata:{i}>"]


def record(kind, body, rid="<a>", length=None):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Concurrent-To: <x>\r\nwarc-concurrent-to: <y>\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_parse_members_junk_and_truncation():
    raw = record("request", b"one") + b"junk\n" + record("response", b"")
    plain = list(W.parse(io.BytesIO(raw + record("metadata", b"short", length=900)[:-4])))
    assert [(r[1], r[6], r[7]) for r in plain] == [("request", b"one", False), ("response", b"", False), ("metadata", b"short", True)]
    assert plain[0][2] == ["<x>", "<y>"]
    members = gzip.compress(record("request", b"one")) + gzip.compress(record("response", b"two" * 100_000))
    assert [(r[1], len(r[6])) for r in W.parse(io.BytesIO(members))] == [("request", 3), ("response", 300_000)]
    assert list(W.parse(io.BytesIO(b""))) == []


@pytest.mark.parametrize("zipped", [False, True])
def test_binary_payloads(spark, tmp_path, zipped):
    raw = b"\x89PNG\r\n\x1a\n\r\n\r\n\xff\xfe\x00" + bytes(range(256)) * 50
    W.write_records(records(spark, [("r", "response", [], raw), ("q", "request", ["r"], b"\xc3(")]).coalesce(1), f"file://{tmp_path}/w", gzip=zipped)
    got = W.assemble_files(spark, f"file://{tmp_path}/w").collect()
    assert [(bytes(r.response.payload), bytes(r.requests[0].payload)) for r in got] == [(raw, b"\xc3(")]


def test_damaged_members_and_other_files():
    one, two, three = (gzip.compress(record("response", x * 2000, rid=f"<{k}>")) for k, x in enumerate((b"a", b"bc", b"d")))
    hurt = two[: len(two) // 2] + b"\xff" * 40 + two[len(two) // 2 + 40 :]
    ids = [r[0] for r in W.parse(io.BytesIO(one + hurt + three))]
    assert ids[0] == "<0>" and ids[-1] == "<2>"
    assert list(W.parse(io.BytesIO(b"no archive at all " * 500_000))) == []
    assert list(W.parse(io.BytesIO(gzip.compress(b"nothing")[:-6] + b"??"))) == []
