"""CSV over several files and blocks, versioned tables, upsert of a stream, playlist ids."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import library as L
from tabulon.sources.csv_records import csv_files
from tabulon.sources.versioned import VersionedTable
from tabulon.streaming.upsert_stream import upsert_batch, upsert_stream

PIECES = ["a", "é", ",", '"', "\n", "\r\n", " ", "long text " * 3, "", "x"]


def write_csv(path, header, rows, mark=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if mark else "utf-8") as f:
        out = csv.writer(f, lineterminator="\r\n" if mark else "\n")
        out.writerow(header)
        out.writerows(rows)


def read_back(path):
    with open(path, newline="", encoding="utf-8-sig") as f:
        return list(csv.DictReader(f))


@pytest.fixture()
def folder(tmp_dir):
    """Three files with quoted line breaks, quotes and commas; one with a byte order mark and another column order."""
    rng = random.Random(3)
    src = os.path.join(tmp_dir, "in put")
    os.makedirs(src)
    for k, header in enumerate((["id", "text", "n"], ["n", "id", "text"], ["id", "text"])):
        rows = [["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))) + str(i) for _ in header] for i in range(120)]
        write_csv(os.path.join(src, f"part {k}.csv"), header, rows, mark=k == 1)
    with open(os.path.join(src, "part 0.csv"), "a", newline="") as f:
        f.write('\n\n"last, one","of\n""two"" lines",9\n')
    return src


@pytest.mark.parametrize("block", ["64b", "1k", "128m"])
def test_records_do_not_depend_on_blocks(spark, folder, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "64b")
    try:
        got = [r.asDict() for r in csv_files(spark, folder).orderBy("_seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    expected = [(i, row) for k in range(3) for i, row in enumerate(read_back(os.path.join(folder, f"part {k}.csv")))]
    assert len(got) == len(expected)
    for g, (i, row) in zip(got, expected):
        assert g["_record"] == i
        assert [(g[c] or "") for c in ("id", "text", "n")] == [row.get(c) or "" for c in ("id", "text", "n")]


def test_the_first_file_wins(spark, tmp_dir):
    src = os.path.join(tmp_dir, "songs")
    os.makedirs(src)
    header = [L.COL_URI, L.COL_TITLE, L.COL_ARTIST, L.COL_VIBE, L.COL_GENRES, L.COL_TAGS, "Energy"]
    write_csv(os.path.join(src, "a.csv"), header, [["u:1", "First", "A", "calm\nnight", "pop", "x", ""], ["", "", "B", "v", "", "", ""]])
    write_csv(os.path.join(src, "b.csv"), header, [["u:1", "Second", "A", "loud", "rock", "y", "0.5"], ["", "", "C", "v", "", "", ""]])
    out = L.import_catalog(csv_files(spark, src))
    (song,) = out["songs"].collect()
    assert (song.title, song.vibe, song.genres, song.energy) == ("First", "calm\nnight", "pop,rock", 0.5)
    assert out["report"].first().asDict() == {"imported": 1, "merged": 1, "skipped": 2, "bad_numbers": 0}
    assert sorted(r.label for r in out["skipped"].collect()) == ["line 3: (no title) - B", "line 3: (no title) - C"]


def test_header_only_and_no_records(spark, tmp_dir):
    src = os.path.join(tmp_dir, "empty")
    os.makedirs(src)
    write_csv(os.path.join(src, "a.csv"), ["id", "id", "b"], [])
    out = csv_files(spark, src)
    assert out.columns[:2] == ["id", "b"] and out.collect() == []


SCHEMA = "id string, v int"


def test_a_reader_sees_the_old_or_the_new_version(spark, tmp_dir):
    table = VersionedTable(spark, os.path.join(tmp_dir, "t"), SCHEMA)
    assert table.read().collect() == [] and table.current()["version"] == 0
    assert table.commit(spark.createDataFrame([("a", 1)], SCHEMA)) == 1
    old = table.read()
    # A writer that is lost before its commit leaves a folder that nobody reads.
    spark.createDataFrame([("z", 9)], SCHEMA).write.parquet(os.path.join(tmp_dir, "t", "v000000000002-lost"))
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    # A table can be replaced by what is read from it.
    table.commit(L.upsert(table.read(), spark.createDataFrame([("b", 2)], SCHEMA), "id"))
    assert [tuple(r) for r in old.collect()] == [("a", 1)]
    assert sorted(map(tuple, VersionedTable(spark, os.path.join(tmp_dir, "t"), SCHEMA).read().collect())) == [("a", 1), ("b", 2)]


def test_two_writers_cannot_commit_one_version(spark, tmp_dir):
    table = VersionedTable(spark, os.path.join(tmp_dir, "t"), SCHEMA)
    table.commit(spark.createDataFrame([("a", 1)], SCHEMA), after=0)
    with pytest.raises(Exception, match="exist"):
        table.commit(spark.createDataFrame([("a", 2)], SCHEMA), after=0)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]


def test_a_stream_of_upserts_equals_the_batch_and_replays_change_nothing(spark, tmp_dir):
    src, rng = os.path.join(tmp_dir, "in"), random.Random(5)
    rows = [(rng.choice("abcdefgh"), i, i) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50:(k + 1) * 50], "id string, v int, seq int").coalesce(1).write.mode("append").parquet(src)
    target = VersionedTable(spark, os.path.join(tmp_dir, "t"), SCHEMA)
    stream = spark.readStream.schema("id string, v int, seq int").option("maxFilesPerTrigger", 1).parquet(src)
    query = upsert_stream(stream, target, os.path.join(tmp_dir, "ckpt"))
    query.awaitTermination()
    assert query.exception() is None
    expected = {i: v for i, v, _ in rows}
    got = target.read().collect()
    assert {r.id: r.v for r in got} == expected and len(got) == len(expected)
    version = target.current()["version"]
    late = spark.createDataFrame([("a", -1, 999)], "id string, v int, seq int")
    assert upsert_batch(target, late, 2, "id", "seq") is False and target.current()["version"] == version
    assert upsert_batch(target, late, 77, "id", "seq") is True
    assert {r.id: r.v for r in target.read().collect()} == expected | {"a": -1}


PLAYLIST = "id string, name string, query string, tracks array<string>, created_at string, updated_at string"


def test_playlists_whose_fields_run_together_keep_their_rows(spark):
    new = [(None, "a|b", "c", ["x"], None, None), (None, "a", "b|c", ["x"], None, None), (None, None, "n", ["x"], None, None),
           (None, "n", None, ["x"], None, None)]
    out = L.save_playlists(spark.createDataFrame([], PLAYLIST), spark.createDataFrame(new, PLAYLIST), "2024", "1").collect()
    assert len(out) == 4 and len({r.id for r in out}) == 4


def test_saving_an_equal_playlist_again_adds_one(spark):
    new = spark.createDataFrame([(None, "n", "q", ["x"], None, None)], PLAYLIST)
    once = L.save_playlists(spark.createDataFrame([], PLAYLIST), new, "2024")
    twice = L.save_playlists(spark.createDataFrame(once.collect(), PLAYLIST), new, "2024")
    assert twice.count() == 2
    # The same save name gives the same beginning: the longer id is taken.
    first = spark.createDataFrame(L.save_playlists(spark.createDataFrame([], PLAYLIST), new, "2024", "s").collect(), PLAYLIST)
    again = L.save_playlists(first, new, "2024", "s").collect()
    assert sorted(len(r.id) for r in again) == [8, 64]
