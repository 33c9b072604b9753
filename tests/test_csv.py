from __future__ import annotations

import pytest

from hookflow.session import scratch_path
from hookflow.sources import csv_batch_stats, csv_chunks, ingest_csv
from hookflow.sources.csv_batch import POSITION, numbered_in_place


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_strict_reading(spark, tmp_path):
    path = write(tmp_path, '# note\nid,name,email\n1,"a, b",x@y\n# skip\n2,,"q ""z"""\n')
    rows = ingest_csv(spark, path)
    assert rows.columns == ["id", "name", "email"]
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", "a, b", "x@y"), ("2", "", 'q "z"')]


@pytest.mark.parametrize("bad", ["1,a\n", "1,a,b,c\n"])
def test_ragged_row_fails_even_a_count(spark, tmp_path, bad):
    rows = ingest_csv(spark, write(tmp_path, "id,name,x\n0,a,b\n" + bad))
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        rows.count()
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        rows.select("id").collect()


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (500, [500]), (501, [500, 1]), (1000, [500, 500])])
def test_chunks(spark, tmp_path, n, sizes):
    rows = ingest_csv(spark, write(tmp_path, "id,v\n" + "".join(f"{i},v{i}\n" for i in range(n))), position=True)
    chunks = csv_chunks(rows, POSITION).orderBy("chunk_index").collect()
    assert [c.total_rows for c in chunks] == sizes
    assert [c.chunk_index for c in chunks] == list(range(len(sizes)))
    assert [r["id"] for c in chunks for r in c.rows] == [str(i) for i in range(n)]
    stats = csv_batch_stats(rows).first()
    assert (stats.total_rows, stats.chunks_queued) == (n, len(sizes))


def test_file_order_survives_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        text = "id,v\n" + "".join(f"{i},{'x' * 50}\n" for i in range(3000))
        rows = ingest_csv(spark, write(tmp_path, text), position=True)
        assert rows.rdd.getNumPartitions() > 3
        got = [r["id"] for c in csv_chunks(rows, POSITION, 700).orderBy("chunk_index").collect() for r in c.rows]
        assert got == [str(i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_order_needs_no_sort(spark, tmp_path):
    """Several files in several splits, with and without rows dropped after they were numbered."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        folder = tmp_path / "many"
        folder.mkdir()
        for part in range(3):
            write(folder, "id,v\n" + "".join(f"{part}-{i},{'x' * 50}\n" for i in range(1000)), f"{part}.csv")
        rows = ingest_csv(spark, str(folder), position=True)
        numbered = numbered_in_place(rows)
        text = numbered._jdf.queryExecution().executedPlan().toString()
        # What is sorted has a row for each split.
        assert text.count("Sort [") == 1 and "rangepartitioning" not in text and "Exchange hashpartitioning" not in text
        want = [f"{part}-{i}" for part in range(3) for i in range(1000)]
        assert {r.id: r.row_number for r in numbered.collect()} == {name: n for n, name in enumerate(want)}
        dropped = rows.filter("not id like '%7'")
        kept = [name for name in want if not name.endswith("7")]
        assert {r.id: r.row_number for r in numbered_in_place(dropped).collect()} == {name: n for n, name in enumerate(kept)}
        got = [r["id"] for c in csv_chunks(dropped, POSITION, 700).orderBy("chunk_index").collect() for r in c.rows]
        assert got == kept
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_hook_and_round_trip(spark, tmp_path):
    path = scratch_path(spark, "csv")
    spark.range(5).selectExpr("id", "concat('n', id) as name").write.csv(path, header=True)
    rows = ingest_csv(spark, path, ["id", "name"], row_transform=lambda df: df.filter("id > 2"))
    assert sorted(r.name for r in rows.collect()) == ["n3", "n4"]
