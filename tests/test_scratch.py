from pathlib import Path

from orrerix import scratch


def test_stored_tables_are_deleted(spark):
    a, b, c = (scratch.stored(spark.range(n), "t") for n in (3, 4, 5))
    folders = [Path(x.orrerix_path.removeprefix("file://")) for x in (a, b, c)]
    assert [x.count() for x in (a, b, c)] == [3, 4, 5] and all(f.is_dir() for f in folders)
    scratch.discard(a, spark.range(1))
    assert [f.is_dir() for f in folders] == [False, True, True]
    assert scratch.clear(spark) >= 2 and not any(f.is_dir() for f in folders) and scratch.clear(spark) == 0
    small = scratch.stored(spark.range(100).sortWithinPartitions("id"), "t", "zstd", 1 << 16)
    assert small.count() == 100 and list(Path(small.orrerix_path.removeprefix("file://")).glob("*.zstd.parquet"))
