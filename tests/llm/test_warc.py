"""Archives as files, and members of several records."""

import gzip
import logging
from pathlib import Path

from ledgerlark.llm import warc
from ledgerlark.llm.scratch import Scratch

RECORDS = [warc.record(i, f"http://x/{i}", bytes([65 + i]) * (100 * i + 1)) for i in range(6)]
ids = lambda got: [int(h["warc-record-id"][12:-1]) for _, _, h, _ in got.records]


def test_files_are_gzip_archives_that_other_readers_take(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i * 50)) for i in range(200)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    warc.write_archives(d.repartition(3), folder, Scratch(spark, "test"))
    files = sorted(Path(tmp_path, "out").glob("*.warc.gz"))
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert len(files) == 3 and plain.count(b"WARC/1.1\r\n") == 200 and plain.endswith(b"\r\n\r\n")
    back = warc.read_archives(warc.archives_of(spark, folder)).collect()
    assert sorted(r["page_id"] for r in back) == list(range(200)) and {r["payload"].decode() for r in back if r["record_type"] == "response"} == {"é" * (i * 50) for i in range(200)}


def test_a_damaged_file_gives_all_other_pages_and_its_gap(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 40) for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    warc.write_archives(d.coalesce(1), folder, Scratch(spark, "test"))
    (file,) = Path(tmp_path, "out").glob("*.warc.gz")
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 0x55
    file.write_bytes(raw)
    file.with_name("." + file.name + ".crc").unlink(missing_ok=True)
    back = warc.read_archives(warc.archives_of(spark, folder)).collect()
    gaps = [r for r in back if r["record_type"] == "gap"]
    assert len({r["page_id"] for r in back if r["record_type"] != "gap"}) >= 49 and len(gaps) == 1 and gaps[0]["first_byte"] <= len(raw) // 2 < gaps[0]["end_byte"]


def test_round_trip_logs_no_gap_of_its_own_archives(spark, caplog):
    d = spark.createDataFrame([(i, None, "x" * i) for i in range(30)], "page_id long, url string, html string")
    with caplog.at_level(logging.WARNING):
        assert warc.round_trip(d).count() == 30
    assert "quarantined" not in caplog.text


def test_a_member_of_many_records_loses_only_the_bad_one():
    inner = bytearray(b"".join(RECORDS))
    at = sum(map(len, RECORDS[:3])) + len(RECORDS[3]) - 20
    inner[at] ^= 0xFF
    got = warc.salvage(gzip.compress(bytes(inner)) + warc.member(RECORDS[0]))
    assert ids(got) == [0, 1, 2, 4, 5, 0]
    ((a, b, why),) = got.gaps
    assert a == 0 and why == f"block digest at {sum(map(len, RECORDS[:3]))}-{sum(map(len, RECORDS[:4]))} of the member"


def test_a_member_cut_short_keeps_its_whole_records():
    member = gzip.compress(b"".join(RECORDS))
    got = warc.salvage(member[: len(member) - 30])
    assert ids(got)[:4] == [0, 1, 2, 3] and got.gaps == [(0, len(member) - 30, "member cut short")]


def test_a_record_longer_than_is_held_is_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "MOST_RECORD", 1000)
    got = warc.salvage(warc.member(warc.record(9, None, b"a" * 5000)) + warc.member(RECORDS[1]))
    assert ids(got) == [1] and got.gaps[0][2] == "member too long"
