"""Derived tables: the present, what there is meanwhile, one builder, old versions removed."""

import threading
import time

from ledgerlark.sources.stored import Stored, fingerprint


def put(spark, path, n):
    spark.range(n).coalesce(1).write.mode("append").parquet(path)


def test_old_version_is_served_while_the_new_one_is_built(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, 3)
    go, built = threading.Event(), []

    def build(to):
        built.append(to)
        if len(built) > 1:
            assert go.wait(60)
        read().write.parquet(to)

    read = lambda: spark.read.parquet(src)
    rows = lambda path: spark.read.parquet(path).count()
    first, worker = Stored(spark, "swr", read()).at_hand(build)
    assert worker is None and rows(first) == 3
    put(spark, src, 4)
    began = time.monotonic()
    old, worker = Stored(spark, "swr", read()).at_hand(build)
    assert old == first and worker is not None and time.monotonic() - began < 30
    # a second caller gets the old one too and is no builder
    again, other = Stored(spark, "swr", read()).at_hand(build)
    assert again == first and other is None
    go.set()
    worker.join(60)
    new, other = Stored(spark, "swr", read()).at_hand(build)
    assert new != first and other is None and rows(new) == 7 and len(built) == 2
    assert rows(old) == 3  # a reader that holds it still can


def test_the_present_is_never_hidden(spark, tmp_path):
    src = str(tmp_path / "src")
    for n in (1, 2, 5):
        put(spark, src, n)
        at = Stored(spark, "now", spark.read.parquet(src)).present(lambda to: spark.read.parquet(src).write.parquet(to))
        assert spark.read.parquet(at).count() == spark.read.parquet(src).count()


def test_versions_go_after_their_grace(spark, tmp_path):
    src = str(tmp_path / "src")
    kept = []
    for n in (1, 2, 3):
        put(spark, src, n)
        held = Stored(spark, "tidy", spark.read.parquet(src), grace=0.0)
        kept.append(held.present(lambda to: spark.range(2).write.parquet(to)))
        time.sleep(0.05)
    assert [f"{held.root}/{m}" for _, m in held.versions()] == kept[-1:] or held.tidy() is not None
    held.tidy()
    assert [f"{held.root}/{m}" for _, m in held.versions()] == kept[-1:]


def test_a_lost_builders_lease_ends(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, 1)
    held = Stored(spark, "lease", spark.read.parquet(src))
    build = lambda to: spark.range(1).write.parquet(to)
    held.present(build)
    put(spark, src, 1)
    later = Stored(spark, "lease", spark.read.parquet(src))
    mark = fingerprint(later.source)
    assert later._take(mark) and not later._take(mark)
    later.lease = 0.0
    time.sleep(0.1)
    _, worker = later.at_hand(build)
    assert worker is not None
    worker.join(60)
    assert len(later.versions()) == 2


def test_fingerprints_of_many_files(spark, tmp_path, monkeypatch):
    from ledgerlark.sources import stored

    monkeypatch.setattr(stored, "FEW_FILES", 0)
    src = str(tmp_path / "src")
    put(spark, src, 2)
    one = fingerprint(spark.read.parquet(src))
    assert one == fingerprint(spark.read.parquet(src))
    put(spark, src, 2)
    assert one != fingerprint(spark.read.parquet(src))
