import base64
import hashlib
import random
from pathlib import Path

import pytest

from wardline.llm import warc

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        size = len((html or "").encode())
        first = max(same, default=None)
        revisit = size >= least and i != first and sum((h or "") == (html or "") for *_, h in rows) > 1
        out.append((i, size, digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS id", "'x' AS record", "2 AS size")


def found(df, **options):
    return sorted((tuple(r) for r in warc.round_trip(df, **options).collect()), key=repr)


def test_round_trip_with_hostile_payloads(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        inner = "".join(rng.choice(["a", "é", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "𝄞", "\n", FAKE.format(rng.randint(0, 40), "x" * 20)]) for _ in range(rng.randint(0, 30)))
        rows.append((i, f"http://h/{i}\r\nEvil: 1", inner))
    rows += [(200 + i, None, "same") for i in range(30)] + [(None, "u", "same"), (None, None, None), (400, "u", ""), (401, "u", "x" * 300_000), (402, "u", rows[0][2])]
    df = frame(spark, rows)
    for size in (97, 1 << 20):
        assert found(df, range_bytes=size) == plain(rows)
    assert found(df, least_bytes=5) == plain(rows, 5)


def test_files_are_cut_and_repeated_rows(spark, tmp_path):
    rows = [(i, "u", f"page {i // 3}" + FAKE.format(3, "abc")) for i in range(40)] + [(39, "u", "page 13" + FAKE.format(3, "abc"))] * 2
    path = str(tmp_path / "out")
    assert found(frame(spark, rows), path=path, records_per_file=7) == plain(rows)
    import glob

    files = glob.glob(path + "/part-*")
    assert len(files) >= 6
    for f in files:  # a plain sequential reader
        data, at = open(f, "rb").read(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            head = data.index(b"\r\n\r\n", at)
            size = int(next(x for x in data[at:head].split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
            at = head + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4


def test_given_table_against_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert found(pages) == plain(rows)


def test_empty_and_damaged(spark, tmp_path):
    df = frame(spark, [(1, "u", "a"), (2, "u", "b"), (3, "u", "c")])
    assert found(df.limit(0)) == []
    path = str(tmp_path / "out")
    warc.write(df.coalesce(1), path)
    import glob

    (file,) = glob.glob(path + "/part-*")
    data = open(file, "rb").read()
    third = data.index(b"WARC/1.1", data.index(b"WARC/1.1", 5) + 5)
    open(file, "wb").write(data[: third - 4] + b"x" + data[third - 4 :])
    assert warc.read(spark, path).count() == 2  # the second record's length no longer leads to the third


def test_headers_of_any_length(spark):
    rows = [(i, "data:" + "x" * (3 << 19) if i == 2 else "u", f"page {i % 5}" + FAKE.format(3, "abc")) for i in range(9)]
    df = frame(spark, rows).coalesce(1)
    for size in (1 << 18, 8 << 20):
        assert found(df, range_bytes=size) == plain(rows)


def test_round_trip_of_a_damaged_file_fails(spark, tmp_path, monkeypatch):
    path, write = str(tmp_path / "out"), warc.write

    def damaged(pages, path, **options):
        write(pages.coalesce(1), path, **options)
        (file,) = Path(path).glob("part-*")
        data = file.read_bytes()
        third = data.index(b"WARC/1.1", data.index(b"WARC/1.1", 5) + 5)
        file.write_bytes(data[: third - 4] + b"x" + data[third - 4 :])
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(ValueError, match="bytes"):
        warc.round_trip(frame(spark, [(1, "u", "a"), (2, "u", "b"), (3, "u", "c")]), path=path)
