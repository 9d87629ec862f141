"""File strategies as batch and stream sources."""

import io
import os
import time
import zipfile

import duckdb
import pytest

from inkspan.sources import strategies
from inkspan.sources.staging import new_path


@pytest.fixture
def place(tmp_path):
    folder = tmp_path / "place"
    for k in range(12):
        target = folder / ("" if k % 3 == 0 else f"sub{k % 3}/deep")
        target.mkdir(parents=True, exist_ok=True)
        (target / f"File{k}.{'TXT' if k % 2 else 'pdf.'}").write_bytes(b"x" * k)
    (folder / ".hidden").write_bytes(b"no")
    (folder / "sub1" / "_tmp").mkdir()
    (folder / "sub1" / "_tmp" / "x.txt").write_bytes(b"no")
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as out:
        out.writestr("in/a.csv", "1,2")
        out.writestr("b", "")
    (folder / "box.zip").write_bytes(box.getvalue())
    (folder / "sub2" / "broken.zip").write_bytes(b"PK no archive")
    return str(folder)


def test_listing_equals_a_glob(spark, place):
    rows = strategies.load(spark, "folder_files", place, content=False).collect()
    want = [x[0] for x in duckdb.sql(f"SELECT file FROM glob('{place}/**')").fetchall()]
    assert sorted(r.path for r in rows) == sorted(x for x in want if "/." not in x[len(place) :] and "/_" not in x[len(place) :])
    assert all(r.content is None and r.size_bytes == os.path.getsize(r.path) for r in rows)
    assert {r.name: r.ext for r in rows if r.name.startswith("File")} == {
        f"File{k}.{'TXT' if k % 2 else 'pdf.'}": "txt" if k % 2 else "pdf" for k in range(12)
    }


def test_one_bad_item_does_not_stop_the_others(spark, place):
    rows = strategies.load(spark, "zip_files", place).collect()
    inside = {(r.member, bytes(r.content)) for r in rows if r.path.endswith("box.zip")}
    assert inside == {("in/a.csv", b"1,2"), ("b", b"")}
    (bad,) = [r for r in rows if r.error]
    assert bad.name == "broken.zip" and bad.error == "BadZipFile" and bad.content is None
    assert len(rows) == 12 + 2 + 1


def test_a_strategy_can_be_added_and_an_unknown_one_is_refused(spark, place):
    def lines(path):
        for k, line in enumerate(strategies.read_whole(path).splitlines()):
            yield f"line{k}", line

    strategies.register(spark, {"line_files": lines})
    rows = spark.read.format("line_files").load(place).filter("name LIKE 'line%'").collect()
    assert {r.member for r in rows} == {"line0"} and len(rows) >= 11
    with pytest.raises(ValueError, match="unknown strategy"):
        strategies.load(spark, "mailbox", place)


def test_stream_gives_every_file_once(spark, place):
    path, state = new_path(spark, "seen"), new_path(spark, "state")
    seen = []
    for k in range(3):
        if k:
            with open(f"{place}/sub1/late{k}.txt", "wb") as file:
                file.write(b"late")
        stream = strategies.load(spark, "folder_files", place, stream=True, settle_seconds=0)
        stream.select("path", "size_bytes").writeStream.option("checkpointLocation", state).trigger(availableNow=True).format(
            "parquet"
        ).start(path).awaitTermination()
        seen.append(sorted(r.path for r in spark.read.parquet(path).collect()))
        time.sleep(0.05)
    assert len(seen[0]) == 14 and len(seen[1]) == 15 and len(seen[2]) == 16 == len({*seen[2]})
