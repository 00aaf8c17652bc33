from __future__ import annotations

import os
import random

import pytest
from tabulon.sources import (
    literal_table,
    materialize,
    read_delimited,
    read_many,
    register_views,
    release,
    shared_folder,
    table_scope,
    write_delimited,
    write_report,
)
from workload.catalog import catalog_job
from workload.telemetry import telemetry_job


def test_quoted_cells_read_as_one_row(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"A ""q"" title"\n2,"line1\nline2, x"\n3,\n', encoding="utf-8")
    rows = [tuple(r) for r in read_delimited(spark, str(path), multi_line=True).collect()]
    assert rows == [("1", 'A "q" title'), ("2", "line1\nline2, x"), ("3", None)]


def test_windows_line_ends(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n2,z\r\n')
    df = read_delimited(spark, str(path), multi_line=True)
    assert df.columns == ["a", "b"]
    # A file's own kind of line end is read as \n, inside cells too.
    assert [tuple(r) for r in df.collect()] == [("1", "x\ny"), ("2", "z")]


def test_every_column_is_text_and_a_surplus_field_is_dropped(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n3,4,5\n", encoding="utf-8")
    df = read_delimited(spark, str(path), multi_line=True)
    assert [t for _, t in df.dtypes] == ["string", "string"]
    assert [tuple(r) for r in df.collect()] == [("1", "2"), ("3", "4")]


def test_given_columns_are_checked_against_the_header(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n", encoding="utf-8")
    assert read_delimited(spark, str(path), columns=["a", "b"]).count() == 1
    with pytest.raises(Exception, match="header"):
        read_delimited(spark, str(path), columns=["a", "c"]).collect()


def test_round_trip_keeps_everything_but_the_empty_string(spark, tmp_path):
    cells = ["  padded  ", 'say "hi", you', "two\nlines", "back\\slash", "tab\there", "cr\rhere", "a\r\nb", "ünï", None]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)] + [("e", "")], "id string, c string")
    write_delimited(df, str(tmp_path / "out"))
    found = {r.id: r.c for r in read_delimited(spark, str(tmp_path / "out"), multi_line=True).collect()}
    assert found == {**{str(i): c for i, c in enumerate(cells)}, "e": None}


def test_folder_of_files_and_partitions(spark, tmp_path):
    write_delimited(spark.range(100).repartition(5), str(tmp_path / "out"))
    df = read_delimited(spark, str(tmp_path / "out"), multi_line=False, partitions=3)
    assert df.count() == 100 and df.rdd.getNumPartitions() == 3


def test_sources_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("c,a\n3,4\n", encoding="utf-8")
    df = read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert df.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in df.collect()) == sorted([("1", "2", None), ("4", None, "3")], key=str)
    with pytest.raises(ValueError):
        read_many(spark, [])


def test_literal_table(spark):
    columns = {"name": ["Ida", "Uwe"], "size": [3, 8], "place": ["north", "south"]}
    df = literal_table(spark, columns, "name string, size int, place string")
    assert [tuple(r) for r in df.collect()] == list(zip(*columns.values(), strict=True))
    with pytest.raises(ValueError):
        literal_table(spark, {"a": [1], "b": [1, 2]}, "a int, b int")


def test_report_is_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "reports" / "top.csv")
    df = spark.range(50).repartition(7).orderBy("id")
    write_report(df, path, limit=3)
    with open(path, encoding="utf-8") as file:
        assert file.read() == "id\n0\n1\n2\n"
    write_report(df, path)
    with open(path, encoding="utf-8") as file:
        assert [line.strip() for line in file] == ["id", *map(str, range(50))]


def test_report_without_rows_has_a_header(spark, tmp_path):
    path = str(tmp_path / "empty.csv")
    write_report(spark.range(0), path)
    with open(path, encoding="utf-8") as file:
        assert file.read().strip() == "id"


def test_large_report_is_written_whole_and_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    write_report(spark.range(2), path)
    write_report(spark.range(1_000_500), path)
    with open(path, encoding="utf-8") as file:
        assert sum(1 for _ in file) == 1_000_501


def test_files_are_split_by_default(spark, tmp_path):
    write_report(spark.range(2_000_000), str(tmp_path / "big.csv"))
    assert read_delimited(spark, str(tmp_path / "big.csv"), columns=["id"]).rdd.getNumPartitions() > 1


def test_materialized_table_lies_in_the_shared_folder(spark):
    kept = materialize(spark.range(10).selectExpr("id", "id % 3 as k"), "numbers")
    assert kept.count() == 10
    assert os.path.realpath(kept.inputFiles()[0].removeprefix("file:")).startswith(
        os.path.realpath(shared_folder(spark))
    )
    assert shared_folder(spark) == shared_folder(spark)


def test_named_views(spark):
    register_views(numbers_view=spark.range(4))
    assert spark.sql("select count(*) as n from numbers_view").first().n == 4


@pytest.fixture
def small_ranges(spark):
    """Files are split every 200 bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def multi_line_cell(draw):
    if draw.random() < 0.3:
        return draw.choice(["", "plain", "  padded ", "7"])
    parts = ["a", "bé", ",", '""', "\n", "\n\n", " ", "long " * 9, ',\n"",']
    return '"' + "".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) + '"'


@pytest.mark.parametrize(("seed", "end", "closed"), [(1, "\n", True), (2, "\r\n", True), (3, "\n", False), (4, "\r\n", False)])
def test_split_reading_agrees_with_whole_files(spark, small_ranges, tmp_path, seed, end, closed):
    draw = random.Random(seed)
    for number in range(3):
        lines = ['"id",b,"c\nc"', *[f"{number}-{i},{multi_line_cell(draw)},{multi_line_cell(draw)}" for i in range(150)]]
        lines[40:40] = ["", "  "]
        text = "\n".join(lines).replace("\n", end) + (end if closed else "")
        (tmp_path / f"{number}.csv").write_bytes(text.encode())
    whole = read_delimited(spark, str(tmp_path), multi_line=True)
    parts = read_delimited(spark, str(tmp_path), multi_line=True, split=True)
    assert parts.columns == whole.columns == ["id", "b", "c\nc"]
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    assert parts.count() == 453


def test_one_large_cell_over_many_ranges(spark, small_ranges, tmp_path):
    path = tmp_path / "a.csv"
    cell = "\n".join(f'line {i}, ""quoted"",\n' for i in range(400))
    path.write_text(f'a,b\n1,"{cell}"\n2,x\n', encoding="utf-8")
    rows = sorted(tuple(r) for r in read_delimited(spark, str(path), multi_line=True, split=True).collect())
    assert rows == [("1", cell.replace('""', '"')), ("2", "x")]


def test_one_multi_line_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\ny {i}"\n' for i in range(2000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scanned = spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions()
        rows = read_delimited(spark, str(path), columns=["a", "b"], multi_line=True, split=True)
        assert scanned > 5 and rows.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert read_delimited(spark, str(path), multi_line=True).rdd.getNumPartitions() == 1


def test_split_reading_refuses_what_it_cannot_tell(spark, tmp_path):
    (tmp_path / "stray.csv").write_text('a,b\n1,5" disk\n', encoding="utf-8")
    (tmp_path / "other.csv").write_text("a,c\n1,2\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    read = lambda name, **options: read_delimited(spark, str(tmp_path / name), multi_line=True, split=True, **options)
    with pytest.raises(Exception, match="quote inside"):
        read("stray.csv").collect()
    with pytest.raises(ValueError, match="header"):
        read("other.csv", columns=["a", "b"])
    with pytest.raises(ValueError, match="header"):
        read_delimited(spark, [str(tmp_path / "stray.csv"), str(tmp_path / "other.csv")], multi_line=True, split=True)
    with pytest.raises(ValueError, match="no header"):
        read("empty.csv")
    assert read("empty.csv", columns=["a"]).collect() == []


def test_a_cell_with_a_line_break_is_not_read_as_two_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"x\ny"\n', encoding="utf-8")
    with pytest.raises(Exception, match="multi_line"):
        read_delimited(spark, str(path), columns=["a", "b"]).collect()
    assert [tuple(r) for r in read_delimited(spark, str(path), columns=["a", "b"], multi_line=True).collect()] == [("1", "x\ny")]


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """A shared folder of this test's own."""
    monkeypatch.setattr("tabulon.sources.shared.shared_folder", lambda session: str(tmp_path / "shared"))
    return tmp_path / "shared"


def listed(folder):
    return sorted(os.listdir(folder)) if folder.exists() else []


def test_a_scope_removes_the_tables_of_its_job(spark, shared):
    outer = materialize(spark.range(3), "outer")
    with table_scope():
        kept = materialize(spark.range(5), "first")
        with table_scope():
            assert materialize(kept, "inner").count() == 5
            assert len(listed(shared)) == 3
        assert kept.count() == 5 and len(listed(shared)) == 2
        read_delimited(spark, write(spark, shared), multi_line=True, split=True).count()
        assert len(listed(shared)) > 2
    assert outer.count() == 3 and len(listed(shared)) == 2
    release(outer, spark.range(1))
    assert len(listed(shared)) == 1


def write(spark, shared):
    write_delimited(spark.range(3), str(shared / "rows"))
    return str(shared / "rows")


def test_a_scope_that_fails(spark, shared):
    for keep in (False, True):
        with pytest.raises(ValueError, match="stop"), table_scope(keep_on_error=keep):
            materialize(spark.range(3), "rows")
            raise ValueError("stop")
        assert len(listed(shared)) == keep


def test_whole_jobs_leave_nothing_behind(spark, shared, small):
    for job in (catalog_job, telemetry_job):
        with table_scope():
            rows = job(spark, small).collect()
            assert rows and len(listed(shared)) > 0
        assert listed(shared) == []


def test_a_named_report_is_written_by_many_tasks_in_order(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("id", "concat('cell, \"', id, '\"') as text").repartition(7).orderBy("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = rows.rdd.getNumPartitions()
        for _ in range(2):
            write_report(rows, str(tmp_path / "rows.csv"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written > 1 and os.listdir(tmp_path).count("rows.csv") == 1 and not [f for f in os.listdir(tmp_path) if "unfinished" in f and not f.startswith(".")]
    lines = (tmp_path / "rows.csv").read_text().splitlines()
    assert lines[0] == "id,text" and len(lines) == 200_001
    assert [int(line.split(",")[0]) for line in lines[1:]] == list(range(200_000)) and lines[8] == '7,"cell, ""7"""'


def test_a_report_without_rows_is_its_header(spark, tmp_path):
    write_report(spark.range(0).selectExpr("id", "'x' as `a, b`"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == 'id,"a, b"\n'
    write_report(spark.range(9), str(tmp_path / "none.csv"), limit=2)
    assert (tmp_path / "none.csv").read_text() == "id\n0\n1\n"
