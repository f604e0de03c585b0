import gzip

import pytest

from tabwise.llm import warc
from tabwise.llm.common import open_to_read


def brute(rows, revisit_from=0):
    top, n = {}, {}
    for page, _, html in rows:
        data = (html or "").encode()
        n[data] = n.get(data, 0) + 1
        if page is not None:
            top[data] = max(top.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        holder = top.get(data)
        revisit = n[data] > 1 and len(data) >= revisit_from and holder is not None and page != holder
        out.append((page, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ü x\r\ny", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "same"), (9, "http://c", "same"),
        (9, "http://d", "same"), (None, "http://e", "same"), (None, "http://f", "lone"), (5, "http://g", "x\r\n\r\nWARC/1.1\r\n\r\n" * 3)]


@pytest.mark.parametrize("revisit_from", [0, 3, 100])
def test_defined_cases_against_brute_force(spark, revisit_from):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, size int, digest string").repartition(3)
    got = warc.read_records(warc.write_archives(df, revisit_from)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(ROWS, revisit_from)
    texts = {h or "" for _, _, h in ROWS}
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == texts
    assert sorted((str(r["url"]) for r in got)) == sorted(str(u) for _, u, _ in ROWS)


def test_archives_are_plain_gzip_members_and_roll(spark):
    df = spark.range(50).selectExpr("id page_id", "concat('http://x/', id) url", "repeat(concat('page ', id, ' '), 40) html").coalesce(1)
    index = warc.write_archives(df, roll_bytes=2000)
    rows = index.collect()
    files = {r["file"] for r in rows}
    assert len(files) > 3
    for name in files:
        with open_to_read(name) as f:
            raw = f.read()
        text = gzip.decompress(raw)
        mine = sorted((r["offset"], r["length"]) for r in rows if r["file"] == name)
        assert text.count(b"WARC-Type: response") == len(mine) and text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and mine[-1][0] + mine[-1][1] == len(raw)
    some = warc.read_records(index.where("page_id % 7 = 3"), gap=0, most=500).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in some} == {i: f"page {i} " * 40 for i in range(50) if i % 7 == 3}


def test_near_ranges_are_one_read(monkeypatch, tmp_path):
    import pyarrow as pa

    record = [warc._gzip(warc.make_record(i, "http://a", b"x" * i, None, warc.base32_sha1(b"x" * i)), 1) for i in range(6)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(record))
    at = [sum(map(len, record[:i])) for i in range(6)]
    pick = [0, 1, 3, 5]
    batch = pa.RecordBatch.from_pydict({
        "page_id": pick, "url": ["http://a"] * 4, "file": [str(path)] * 4, "offset": [at[i] for i in pick], "length": [len(record[i]) for i in pick],
        "payload_digest": [warc.base32_sha1(b"x" * i) for i in pick], "record_type": ["response"] * 4})
    reads = []
    monkeypatch.setattr(warc, "open_to_read", lambda p: reads.append(p) or open(p, "rb"))
    for gap, n in ((0, 3), (1 << 16, 1)):
        reads.clear()
        got = list(warc._reader(gap, 1 << 20, True)([batch]))
        assert len(reads) == n and [x for b in got for x in b.column("payload_bytes").to_pylist()] == pick


def test_damage_is_noticed(spark, tmp_path):
    raw = warc.make_record(1, "http://a", b"body", None, warc.base32_sha1(b"body"))
    assert warc.parse_record(raw)[:6] == (1, "http://a", 4, warc.base32_sha1(b"body"), "response", None)
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"body", b"bodx"))
    with pytest.raises(ValueError):
        warc.parse_record(raw[3:])


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(empty)).collect() == []
