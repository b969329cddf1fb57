"""Session files that grow between readings: each line once, and anew where a file or the generation is another."""

import json
import os

import pytest

from tidemark.session import new_path
from tidemark.sources import cursors

FIELDS = "id long, text string"


def line(i, text="x"):
    return json.dumps({"id": i, "text": text}) + "\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs/inner").mkdir(parents=True)
    return tmp_path / "logs"


@pytest.fixture
def sync(spark, folder):
    name = f"rows-{folder}"
    cursors.register_collector(name, cursors.json_collector(FIELDS))
    out, checkpoint = new_path(spark, "lines"), new_path(spark, "checkpoint")

    def run(**options):
        before = set(map(tuple, spark.read.parquet(out).collect())) if os.path.isdir(out.removeprefix("file://")) else set()
        cursors.collect(spark, name, str(folder), out, checkpoint, **options)
        rows = list(map(tuple, spark.read.parquet(out).collect()))
        assert len(rows) == len(set(rows))
        return sorted((os.path.basename(r[0]), r[1], r[3]) for r in set(rows) - before)

    return run


def test_only_new_lines_of_grown_files(folder, sync):
    one, two = folder / "one.jsonl", folder / "inner/two.jsonl"
    one.write_text(line(1) + line(2))
    two.write_text(line(10) + line(11).rstrip())  # its last line is still being written
    (folder / "_temporary").write_text(line(99))
    assert sync() == [("one.jsonl", 1, 1), ("one.jsonl", 1, 2), ("two.jsonl", 1, 10)]
    assert sync() == []
    with one.open("a") as f:
        f.write(line(3, "é" * 40_000) + line(4))
    with two.open("a") as f:
        f.write("\n" + line(12))
    (folder / "new.jsonl").write_text(line(20))
    assert sync() == [("new.jsonl", 1, 20), ("one.jsonl", 1, 3), ("one.jsonl", 1, 4), ("two.jsonl", 1, 11), ("two.jsonl", 1, 12)]
    os.utime(one)  # touched, not changed
    two.unlink()
    assert sync() == []


def test_a_file_written_anew_is_read_from_its_start(folder, sync):
    one = folder / "one.jsonl"
    one.write_text(line(1) + line(2) + line(3))
    assert [r[2] for r in sync()] == [1, 2, 3]
    one.write_text(line(7))
    assert [r[2] for r in sync()] == [7]
    one.write_text(line(8) + line(9) + line(10))
    assert [r[2] for r in sync()] == [8, 9, 10]


def test_a_new_generation_reads_all_again(folder, sync):
    (folder / "one.jsonl").write_text(line(1) + line(2))
    assert len(sync()) == 2
    assert sync(generation="2") == [("one.jsonl", 2, 1), ("one.jsonl", 2, 2)]
    assert sync(generation="2") == []


def test_stretches_share_out_every_line_once(tmp_path):
    path = tmp_path / "f.jsonl"
    texts = [line(i, "y" * (i * 7 % 50)) for i in range(300)] + ["\n", "not json\r\n", "no end"]
    path.write_text("".join(texts))
    end = {"generation": 1, "files": {str(path): cursors.cursor_of(str(path))}}
    for first in (0, len("".join(texts[:120]).encode())):
        start = {"generation": 1, "files": {str(path): [1, 1, first, cursors.head_check(str(path), first)]}}
        for size in (1, 13, 64, 1000, 1 << 20):
            got = [r for part in cursors.new_stretches(start, end, size) for r in cursors.read_stretch(part)]
            want = [t.rstrip("\r\n") for t in texts[120 if first else 0 : -1] if t.strip()]
            assert [r[3] for r in got] == want and len({r[2] for r in got}) == len(got)


def test_batch_reading_and_bad_lines(spark, folder):
    (folder / "one.jsonl").write_text(line(1) + "not json\n" + "[1]\n")
    spark.dataSource.register(cursors.SessionLines)
    read = lambda p: spark.read.format("session-lines").load(str(p))
    rows = {r.pos: (r.id, r.ok) for r in cursors.json_collector(FIELDS)(read(folder)).collect()}
    assert [rows[p] for p in sorted(rows)] == [(1, True), (None, False), (None, True)]
    assert read(folder / "inner").count() == 0


def test_a_collector_has_one_name():
    cursors.register_collector("mine", len)
    cursors.register_collector("mine", len)
    with pytest.raises(ValueError):
        cursors.register_collector("mine", max)
