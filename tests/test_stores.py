"""Snapshot tables, fetching only what is new, the intake stream over many batches, and ranks of hashed ids."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from inkspan.functions.ranking import with_position
from inkspan.operators import ingest
from inkspan.sources import fetch as fetching
from inkspan.sources.files import scan_files
from inkspan.sources.snapshots import Conflict, SnapshotTable
from inkspan.sources.staging import new_path
from inkspan.streaming import jobs

ROWS = "company_id long, doc_id long, name string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "store"), spark.createDataFrame([], ROWS).schema, "company_id")
    table.replace(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (None, 4, "d")], ROWS), [1, 2, None])
    return table


def test_versions_of_a_snapshot_table(spark, store):
    assert SnapshotTable(spark, store.path + "-none", store.schema, "company_id").read().count() == 0
    doomed = spark.createDataFrame([(1, 2, "x"), (2, 9, "x"), (None, 4, "x")], ROWS)
    assert store.delete(doomed.filter("company_id IS NOT NULL"), ["doc_id"]) == 2
    assert rows_of(store.read()) == [(1, 1, "a"), (2, 3, "c"), (None, 4, "d")]
    assert len(rows_of(store.read(1))) == 4  # the old version still reads
    store.replace(spark.createDataFrame([], ROWS), [2])
    assert rows_of(store.read()) == [(1, 1, "a"), (None, 4, "d")] and store.version() == 3
    assert store.delete(spark.createDataFrame([], ROWS), ["doc_id"]) == 3


def test_only_parts_of_the_keys_are_written_again(spark, store):
    before = store.parts()
    store.replace(spark.createDataFrame([(2, 7, "z")], ROWS), [2])
    after = store.parts()
    assert after["1"] == before["1"] and after[""] == before[""] and after["2"] != before["2"]
    with pytest.raises(ValueError, match="other keys"):
        store.replace(spark.createDataFrame([(1, 7, "z")], ROWS), [2])


def test_a_killed_write_is_invisible(spark, store, monkeypatch):
    seen = rows_of(store.read())
    broken = spark.createDataFrame([(1, 5, "e")], ROWS).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.replace(broken, [1])
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # data written, commit not
    with pytest.raises(KeyboardInterrupt):
        store.replace(spark.createDataFrame([(1, 6, "f")], ROWS), [1])
    fresh = SnapshotTable(spark, store.path, store.schema, "company_id")
    assert fresh.version() == 1 and rows_of(fresh.read()) == seen


def test_two_writers_do_not_overwrite_each_other(spark, store):
    seen = store.version()
    store.replace(spark.createDataFrame([(1, 8, "h")], ROWS), [1])
    with pytest.raises(Conflict):
        store.commit(spark.createDataFrame([(2, 9, "i")], ROWS), [2], seen)
    assert rows_of(store.read()) == [(1, 8, "h"), (2, 3, "c"), (None, 4, "d")]


def test_only_new_files_are_opened(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "opened"
    log.mkdir()
    (folder / "deep").mkdir(parents=True)
    for k in range(20):
        (folder / ("deep" if k % 2 else ".") / f"f{k}.txt").write_bytes(b"x" * k)

    def noting(path):
        open(f"{log}/{os.path.basename(path)}-{random.random()}", "w").close()
        return fetching.open_file(path)

    listing = scan_files(spark, str(folder)).withColumns({"data_location_id": F.lit(1), "uuid": ingest.join_identifier(F.col("iuuid"))})
    links = listing.filter("size_bytes % 3 <> 0").select("data_location_id", "uuid")
    wanted = ingest.new_files(listing, links).select("path", "name", "size_bytes")
    gone = spark.createDataFrame([(f"file:{folder}/none.txt", "none.txt", 5), (None, "null", None)], wanted.schema)
    got = {r.name: (r.content, r.fetch_error) for r in fetching.fetch(wanted.filter("size_bytes > 0").union(gone), noting).collect()}
    assert {n: len(c) for n, (c, e) in got.items() if e is None} == {f"f{k}.txt": k for k in range(3, 20, 3)}
    assert got["none.txt"] == (None, "FileNotFoundError") and got["null"][0] is None
    opened = [os.path.basename(x).split("-")[0] for x in glob.glob(f"{log}/*")]
    assert sorted(x for x in opened if x.startswith("f")) == sorted(f"f{k}.txt" for k in range(3, 20, 3))


def test_large_files_are_handed_on_in_parts(spark, tmp_path):
    rng = random.Random(8)
    files = {f"f{n}": rng.randbytes(n) for n in (0, 1, 29, 30, 31, 60, 100)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = [(f"file:{tmp_path}/{n}", n, len(c)) for n, c in files.items()] + [(f"{tmp_path}/none", "none", 5), (None, "null", None)]
    got = fetching.fetch(spark.createDataFrame(rows, "path string, name string, size_bytes long"), part_bytes=30).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.name, r.part)):
        found.setdefault(r.name, []).append(r)
    assert {n: b"".join(r.content for r in p) for n, p in found.items() if n in files} == files
    assert max(len(r.content or b"") for r in got) == 30 and len(found["f60"]) == 2 and len(found["f100"]) == 4
    last = {n: p[-1] for n, p in found.items()}
    assert all([r.is_last for r in p] == [False] * (len(p) - 1) + [True] for p in found.values())
    assert {n: (last[n].md5, last[n].end) for n in files} == {n: (hashlib.md5(c).hexdigest(), len(c)) for n, c in files.items()}
    assert [(last[n].fetch_error, last[n].md5, last[n].end) for n in ("none", "null")] == [("FileNotFoundError", None, None), ("ValueError", None, None)]


ARRIVALS = "doc_id long, company_id long, md5 string, name string, lang string, text string, lang_probability double"


def test_intake_over_many_batches_equals_the_batch_operators(spark):
    rng = random.Random(3)
    rows = [
        (k, rng.randrange(2), rng.choice(["m1", "m2", "m3", None]), rng.choice(["n1", "n2", None]), rng.choice(["en", "de", "xx", None]),
         rng.choice(["t", "t", ""]), rng.choice([0.5, 0.9]))
        for k in range(120)
    ]
    source, path, state = (new_path(spark, x) for x in ("arrivals", "intake", "state"))
    for k in range(0, 120, 30):  # four batches, duplicates across them
        spark.createDataFrame(rows[k : k + 30], ARRIVALS).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, "*.parquet", spark.createDataFrame([], ARRIVALS).schema)
        jobs.intake_stream(stream, path, state, ["en", "de"], 0.7, available_now=True).awaitTermination()
    everything = spark.createDataFrame(rows, ARRIVALS)
    judged = ingest.admit_documents(everything, ["en", "de"], 0.7)
    linked = ingest.dedupe_documents(judged.filter("admission = 'ok'").drop("admission"))
    tables = jobs.intake_tables(spark, path, everything.schema)
    names = ["doc_id", "company_id", "canonical_doc_id", "is_new"]
    assert rows_of(tables["links"].select(names)) == rows_of(linked.select(names))
    assert rows_of(tables["documents"].select(everything.columns)) == rows_of(linked.filter("is_new").select(everything.columns))
    gone = judged.filter("admission <> 'ok'").select("doc_id", "company_id", "admission")
    assert rows_of(tables["rejects"].select("doc_id", "company_id", "reason")) == rows_of(gone)
    assert tables["links"].filter("canonical_doc_id <> doc_id AND canonical_doc_id < 30 AND doc_id >= 90").count() > 0


def test_hashed_ids_fall_into_even_ranges(spark):
    docs = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("doc_id"), (F.col("id") % 3).alias("label"))
    ranked = with_position(docs, ["label"], [F.col("doc_id")])
    want, place = sorted(((r.label, r.doc_id) for r in docs.collect())), {}
    for label, doc in want:
        place[label] = place.get(label, 0) + 1
        place[label, doc] = place[label]
    got = ranked.collect()
    assert len(got) == 4000 and all(r.position == place[r.label, r.doc_id] and r.position_of == place[r.label] for r in got)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = docs.repartitionByRange("doc_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 3 * 4000 / len(parts)
