import hashlib

import pytest
import zstandard

from knotwork.llm import warc


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip_and_revisits(spark):
    long, short = "é" * 600, "x" * 999
    rows = [(1, "u", long), (5, None, long), (3, "a\r\nb", long), (7, "u", short), (8, "u", short), (9, "u", None), (None, "u", long), (10, "u", ""), (11, "u", "y" * 1000)]
    got = {r.page_id: r for r in warc.archive_round_trip(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = html == long and page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else body)
    assert got[3].url == "ab" and got[5].url is None


def test_empty_ties_and_repeats(spark):
    assert warc.archive_round_trip(table(spark, [])).count() == 0
    long = "z" * 2000
    got = warc.archive_round_trip(table(spark, [(1, "u", long), (1, "u", long), (0, "u", long)])).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    got = warc.archive_round_trip(table(spark, [(None, "u", long), (None, "u", long)])).collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None)] * 2


def records(n=30):
    return [warc.format_record(i, "u", b"body %d " % i * 50, hashlib.sha1(b"body %d " % i * 50).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(n)]


def test_layout(tmp_path):
    data = warc.build_archive(records())
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    at = 8 + int.from_bytes(data[4:8], "little")
    frames, view = 0, memoryview(data)
    while at < len(data):
        at, frames = warc.frame_end(view, at), frames + 1
    assert frames == 30
    assert [warc.row_of(r)["page_id"] for r in warc.read_archive(data)] == list(range(30))


def test_foreign_archives():
    """No dictionary, a compressed dictionary, streamed frames without sizes, checksums on and off."""
    raw = records(12)
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in raw)
    assert len(list(warc.read_archive(plain))) == 12
    d = zstandard.train_dictionary(2048, [r * 2 for r in records(200)])
    packed = zstandard.ZstdCompressor().compress(d.as_bytes())
    frames = []
    for r in raw:
        c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=len(frames) % 2 == 0).compressobj()
        frames.append(c.compress(r) + c.flush())
    data = (warc.DICT_MAGIC).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + b"".join(frames)
    assert [warc.row_of(r)["page_id"] for r in warc.read_archive(data)] == list(range(12))


@pytest.mark.parametrize("damage", ["cut", "magic", "byte", "length", "version", "digest", "header"])
def test_damage_is_found(damage):
    raw = records(3)
    if damage == "length":
        raw[1] = raw[1].replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1")
    if damage == "version":
        raw[1] = raw[1].replace(b"WARC/1.1", b"WARC/9.9")
    if damage == "digest":
        raw[1] = raw[1].replace(b"body 1 ", b"body 2 ", 1)
    if damage == "header":
        raw[1] = raw[1].replace(b"WARC-Date", b"X-Date")
    data = warc.build_archive(raw)
    if damage == "cut":
        data = data[:-5]
    if damage == "magic":
        data = data[:8] + data[8:].replace((warc.FRAME_MAGIC).to_bytes(4, "little"), b"\0\0\0\0")
    if damage == "byte":
        data = data[:-20] + bytes([data[-20] ^ 255]) + data[-19:]
    with pytest.raises(warc.WarcError):
        [warc.row_of(r) for r in warc.read_archive(data)]


def test_many_archives(spark, tmp_path):
    pages = table(spark, [(i, "u", f"page {i} " * 400) for i in range(200)])
    written = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=50_000).collect() if (tmp_path / "w").mkdir() is None else []
    assert len(written) > 4 and sum(r.records for r in written) == 200
    got = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert sorted(r.page_id for r in got.collect()) == list(range(200))
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".part")]
