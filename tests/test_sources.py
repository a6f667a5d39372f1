"""Readers, hashing and the ledger (FIXTURES.md §1)."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabloom.errors import ArtifactError, DataLoadError
from tabloom.sources import hashing as H
from tabloom.sources import readers as RD
from tabloom.sources import sinks
from tabloom.sources.ledger import Ledger


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def test_csv_tsv_parquet(spark, tmp):
    p = os.path.join(tmp, "a.csv")
    open(p, "w").write("id,name,score\n1,Alice,85.5\n2,Bob,92.0\n3,Charlie,78.3\n")
    df = RD.read_table(spark, p)
    assert df.count() == 3 and "name" in df.columns
    t = os.path.join(tmp, "b.tsv")
    open(t, "w").write("a\tb\n1\t3\n2\t4\n")
    assert RD.read_table(spark, t).columns == ["a", "b"]
    pq = os.path.join(tmp, "c.parquet")
    spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id bigint, category string").write.parquet(pq)
    assert RD.read_table(spark, pq).count() == 3


def test_latin1(spark, tmp):
    p = os.path.join(tmp, "l.csv")
    open(p, "wb").write("name;city\nJosé;Paris\nRené;Nice\n".encode("latin-1"))
    df = RD.read_table(spark, p)
    names = sorted(r["name"] for r in df.collect())
    assert names == ["José", "René"]


def test_errors(spark, tmp):
    x = os.path.join(tmp, "data.xyz")
    open(x, "w").write("x")
    with pytest.raises(DataLoadError, match="No loader registered"):
        RD.read_table(spark, x)
    with pytest.raises(DataLoadError, match="not found"):
        RD.read_table(spark, "/nonexistent/path.csv")


def test_hashing(spark, tmp):
    a, b = os.path.join(tmp, "h1.txt"), os.path.join(tmp, "h2.txt")
    open(a, "w").write("hello")
    open(b, "w").write("world")
    ha = H.compute_file_hash(spark, a)
    assert ha == hashlib.sha256(b"hello").hexdigest() and len(ha) == 64
    assert ha != H.compute_file_hash(spark, b)
    assert len(H.compute_file_hash(spark, a, "md5")) == 32


def test_ledger_and_layout(spark, tmp):
    paths = sinks.init_run(spark, tmp, "r1")
    assert set(paths) == set(sinks.STAGES)
    with pytest.raises(ArtifactError):
        sinks.init_run(spark, tmp, "r1")
    led = Ledger(spark, tmp, "r1")
    led.mark_phase_complete("profile")
    led.mark_phase_complete("profile")
    led.add_experiment("exp_001", "GaussianNB", {"f1": 0.8}, 0.1, is_best=True)
    led.add_artifact("model", "/x/m", "best")
    assert led.completed_phases() == ["profile"]
    assert led.best_experiment().first()["model_name"] == "GaussianNB"
    assert led.artifacts_by_type("model").count() == 1


def test_csv_quotes(spark, tmp_path):
    from tabloom.sources.hashing import row_fingerprints

    path = tmp_path / "q.csv"
    path.write_text('id;note;x\n1;"say ""hi""; ok";1.5\n2;"two\nlines";2.5\n3;plain, text;3.5\n' + "4;z;4.5\n" * 40)
    df = RD.read_csv(spark, str(path))
    rows = {r["id"]: r for r in df.collect()}
    assert df.columns == ["id", "note", "x"] and df.count() == 43
    assert rows[1]["note"] == 'say "hi"; ok' and rows[2]["note"] == "two\nlines" and rows[3]["note"] == "plain, text"
    # values over three lines, with other delimiters in them, read by several tasks
    import csv
    import random

    rng = random.Random(1)
    rows = [(str(i), "".join(rng.choice(['a', ',', ';', '"', "\n", "\r\n", "é", ",,"]) for _ in range(rng.randint(1, 30))), f"x{i}") for i in range(4000)]
    many = tmp_path / "m.csv"
    with open(many, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=";", lineterminator="\n")
        w.writerows([("id", "note", "tag"), *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(str(many)).rdd.getNumPartitions() > 4
        assert RD.csv_facts(spark, str(many)) == {"encoding": "UTF-8", "delimiter": ";", "multiline": True}
        back = RD.read_csv(spark, str(many))
        got = {r["id"]: (r["note"], r["tag"]) for r in back.select(F.col("id").cast("string"), "note", "tag").collect()}
        ref = {i: (n, t) for i, n, t in rows}
        assert back.count() == 4000 and set(got) == set(ref)
        assert {i: (n or "").strip() for i, (n, _) in got.items()} == {i: n.strip() for i, (n, _) in ref.items()}
        # any bytes, in splits of 8 kB
        for k, data in enumerate([b"", b"x", b"a\n", b"\n", b"\xef\xbb\xbfa\r\nb", rng.randbytes(300_000), b"line\n" * 20_000]):
            name = tmp_path / f"b{k}.bin"
            name.write_bytes(data)
            for algorithm in ("sha256", "md5"):
                want = hashlib.new(algorithm, data).hexdigest()
                assert H.file_hashes(spark, str(name), algorithm, stream_above=-1).first()["hash"] == want, k
                assert H.compute_file_hash(spark, str(name), algorithm) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    same = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", "c", None), ("a", "b|c", None)], "x string, y string, z string")
    assert row_fingerprints(same).select("row_hash").distinct().count() == 4


def test_hash_by_splits(spark, tmp_path):
    """A large file is hashed by a task for each split; where digests can't go on, by one task; unpacked by neither."""
    import gzip
    import random

    rng = random.Random(7)
    data = {"a.bin": rng.randbytes(90_000), "b.bin": b"\xef\xbb\xbf" + b"line\n" * 9_000, "c.bin": b"x" * 30_000, "d.csv.gz": gzip.compress(b"x,y\n1,2\n" * 5_000)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    sc, algorithm = spark.sparkContext, "sha384"
    want = {n: hashlib.new(algorithm, c).hexdigest() for n, c in data.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    sc.setJobGroup("hash_by_splits", "")
    try:
        got = H.file_hashes(spark, str(tmp_path), algorithm, stream_above=0).collect()
        tracker = sc.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("hash_by_splits")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["path"].rsplit("/", 1)[1]: r["hash"] for r in got} == want
    assert len(jobs) >= 90_000 // 8192
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(str(tmp_path)).select("path", "length")
    whole = H._streamed(spark, [r["path"] for r in files.collect()], files, algorithm).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["hash"] for r in whole} == {n: h for n, h in want.items() if n.endswith(".bin")}
    for k in (0, 1, 63, 64, 5000):
        first = H.Digest(algorithm)
        first.update(data["a.bin"][:k])
        second = H.Digest(algorithm, first.state)
        second.update(data["a.bin"][k:])
        assert second.hexdigest() == want["a.bin"]


def test_manifest_hash_knows_no_names(spark, tmp_path):
    from tabloom.sources.manifest import manifest

    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    one, two = (manifest(spark, str(tmp_path / n), RD.read_csv(spark, str(tmp_path / n))).first() for n in ("a.csv", "b.csv"))
    assert one["content_hash"] == two["content_hash"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    (tmp_path / "f").mkdir()
    (tmp_path / "g").mkdir()
    for folder in ("f", "g"):
        for k in range(3):
            (tmp_path / folder / f"p{k}.csv").write_text(f"x,y\n{k},2\n")
    f, g = (manifest(spark, str(tmp_path / n), RD.read_csv(spark, str(tmp_path / n))).first() for n in "fg")
    assert f["content_hash"] == g["content_hash"] != one["content_hash"] and f["n_files"] == 3
