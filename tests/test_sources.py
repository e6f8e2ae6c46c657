import gzip
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairnspark import sources


def test_gzip_log_in_parts(spark, tmp_path):
    path = tmp_path / "access.gz"
    with gzip.open(path, "wt") as out:
        out.write("\n".join(f"line {i}" for i in range(1000)) + "\n\n")
    assert sources.read_log(spark, str(path)).rdd.getNumPartitions() == 1
    spread = sources.read_log(spark, str(path), partitions=4)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 1001
    assert spread.columns == ["value"]


def test_ratings_with_and_without_further_columns(spark, tmp_path):
    three, four = tmp_path / "three.csv", tmp_path / "four.csv"
    three.write_text("userId,movieId,rating\n1,2,3.5\n")
    four.write_text("userId,movieId,rating,timestamp\n1,2,3.5,1147880044\n4,5,0.5,1147880044\n")
    assert [tuple(r) for r in sources.read_ratings(spark, str(three)).collect()] == [(1, 2, 3.5)]
    assert [tuple(r) for r in sources.read_ratings(spark, str(four)).collect()] == [(1, 2, 3.5), (4, 5, 0.5)]
    timed = sources.RATINGS.fromDDL("userId int, movieId int, rating double, at bigint")
    assert sources.read_ratings(spark, str(four), timed).columns == ["userId", "movieId", "rating", "at"]


def test_wide_and_tag_tables(spark, tmp_path):
    wide, scores, tags = tmp_path / "w.csv", tmp_path / "s.csv", tmp_path / "t.csv"
    wide.write_text("0.5,1e-3,-1\n2,3,1\n")
    scores.write_text("item_id,tag_id,score\n1,7,0.25\n")
    tags.write_text('tag_id,tag\n7,"so, so"\n')
    df = sources.read_wide(spark, str(wide), 2)
    assert df.dtypes == [("_c0", "double"), ("_c1", "double"), ("_c2", "int")]
    assert [tuple(r) for r in df.collect()] == [(0.5, 0.001, -1), (2.0, 3.0, 1)]
    assert tuple(sources.read_tag_scores(spark, str(scores)).first()) == (1, 7, 0.25)
    assert tuple(sources.read_tags(spark, str(tags)).first()) == (7, "so, so")
    bad = tmp_path / "bad.csv"
    bad.write_text("0.5,x,-1\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED"):
        sources.read_wide(spark, str(bad), 2).collect()


def test_partitioned_parquet_prunes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", (F.col("id") % 3).alias("p"))
    sources.write_parquet(df, path, ["p"])
    back = spark.read.parquet(path)
    assert back.count() == 100
    plan = back.where("p = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_a_hot_partition_value_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "3MB")
    try:
        df = spark.range(0, 200000, 1, 8).select(
            F.sha2(F.col("id").cast("string"), 256).alias("x"),
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("p"),
        )
        path = tmp_path / "out"
        sources.write_parquet(df, str(path), ["p"])
    finally:
        spark.conf.set(key, old)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in path.glob("p=*")}
    assert len(files) == 50 and files["p=0"] > 1
    assert sorted(files.values())[25] <= 2


def test_materialised_table_keeps_schema_and_rows(spark):
    df = spark.range(10).select("id", (F.col("id") % 2 == 0).cast("int").alias("even"))
    stored = sources.materialise(df, "t", ["even"])
    assert stored.dtypes == df.dtypes and sorted(stored.collect()) == sorted(df.collect())


def test_shared_folder_comes_from_the_session():
    def session(root, master):
        context = SimpleNamespace(master=master, applicationId=f"app {master}")
        return SimpleNamespace(conf={"spark.checkpoint.dir": root} if root else {}, sparkContext=context)

    assert sources.fresh_path(session("hdfs://shared/dir/", "yarn"), "x").startswith("hdfs://shared/dir/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sources.fresh_path(session(None, "yarn"), "x")
    local = session(None, "local[2]")
    one, two = sources.fresh_path(local, "x"), sources.fresh_path(local, "x")
    assert one != two and Path(one).parent == Path(two).parent


def test_rejects_keep_their_text(spark, tmp_path):
    one, two = tmp_path / "in" / "one.csv", tmp_path / "in" / "two.csv"
    one.parent.mkdir()
    one.write_text("userId,movieId,rating,timestamp\n1,2,3.5,99\n1,x,3.5,99\n\n4,5\n6,7,0.5,99,extra\n8,,1.5,\n")
    two.write_text('userId,movieId,rating,timestamp\n9,10,"4.0",99\n9,10,"4,0",99\n99999999999,1,1,1\n')
    found = sources.read_checked(spark, str(one.parent), sources.RATINGS)
    assert found.rows.dtypes == [("user_id", "int"), ("item_id", "int"), ("rating", "double")]
    assert sorted(tuple(r) for r in found.rows.collect()) == [(1, 2, 3.5), (8, None, 1.5), (9, 10, 4.0)]
    assert sorted(tuple(r) for r in found.rejects.collect()) == [
        ("1,x,3.5,99", "one.csv"),
        ("4,5", "one.csv"),
        ("6,7,0.5,99,extra", "one.csv"),
        ('9,10,"4,0",99', "two.csv"),
        ("99999999999,1,1,1", "two.csv"),
    ]
    # Both read what was written once: the files are not scanned again.
    for df in found:
        assert "csv" not in df._jdf.queryExecution().executedPlan().toString().lower().replace("one.csv", "")


def test_checked_files_without_a_header_or_without_bad_lines(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("0.5,1e-3,-1\n2,3,1\n2,3\n")
    found = sources.read_checked(spark, str(path), sources.wide_schema(2), header=False)
    assert found.rows.count() == 2 and [r.line for r in found.rejects.collect()] == ["2,3"]
    path.write_text("tagId,tag\n7,\"so, so\"\n")
    found = sources.read_checked(spark, str(path), sources.TAG_NAMES)
    assert [tuple(r) for r in found.rows.collect()] == [(7, "so, so")] and found.rejects.count() == 0


def test_scratch_tables_go_and_others_stay(spark, tmp_path):
    root = Path(sources.fresh_path(spark, "x")).parent
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    out = str(tmp_path / "kept")
    with sources.scratch(spark):
        inner = sources.materialise(spark.range(5), "inner")
        with sources.scratch(spark):
            kept = sources.materialise(sources.materialise(inner, "deep"), "kept", path=out)
        assert inner.count() == 5
    assert kept.count() == 5
    assert ({p.name for p in root.iterdir()} if root.exists() else set()) == before
    sources.release(spark, out)
    assert not Path(out).exists()
