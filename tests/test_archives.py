"""Archive members by ranged reads against what the archives were made of."""

import io
import zipfile

from ledgerlark.sources.archives import archive_members


def test_members_of_archives(spark, tmp_path):
    want = {}

    def put(name, members, comment=b"", before=b"", **how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", **how) as z:
            z.comment = comment
            for m, data in members.items():
                z.writestr(m, data)
        (tmp_path / name).write_bytes(before + out.getvalue())
        want[name] = {m: len(d) for m, d in members.items() if not m.endswith("/")}

    put("plain.zip", {"a.csv": b"1,2", "dir/": b"", "dir/b.txt": b"x" * 5000, "é日本.json": b"{}"})
    put("packed.zip", {"a": b"y" * 100_000}, compression=zipfile.ZIP_DEFLATED)
    put("comment.zip", {"a": b"1"}, comment=b"PK\x05\x06 in a comment " + b"z" * 60_000)
    put("prefixed.zip", {"a": b"1"}, before=b"#!/bin/sh\n" * 100)
    put("many.zip", {f"f{i:05d}": b"" for i in range(70_000)})
    put("empty.zip", {})
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "text.zip").write_bytes(b"PK no archive" * 1000)
    whole = (tmp_path / "plain.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) - 30])
    names = [*want, "none.zip", "text.zip", "cut.zip", "absent.zip"]
    got = archive_members(spark.createDataFrame([(f"file://{tmp_path}/{n}", 1) for n in names] + [(None, 1)], "path string, member int")).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    for name, members in want.items():
        assert {r["member"]: r["bytes"] for r in by.get(name, [])} == members
    for name in ("none.zip", "text.zip", "cut.zip", "absent.zip"):
        assert [r["member"] for r in by[name]] == [None] and by[name][0]["error"]


def test_little_of_a_large_archive_is_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        with z.open("zeros.bin", "w") as f:
            for _ in range(200):
                f.write(bytes(1 << 20))
        for i in range(100):
            z.writestr(f"m{i}.csv", "a,b")
    rows = archive_members(spark.createDataFrame([(f"file://{tmp_path}/large.zip",)], "path string")).collect()
    assert len(rows) == 101 and {r["bytes"] for r in rows} == {200 << 20, 3}
    assert max(r["read"] for r in rows) < 100_000
