import sys

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from cairnspark.llm import decontaminate, simhash, subwords  # noqa: E402
from cairnspark.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        counts.append(docs.count())
        if name == "simhash_near_dedup":
            assert docs.select("doc_id").distinct().count() == counts[-1]
            assert counts[-1] == simhash.groups(before).select("component_id").distinct().count()
        if name == "benchmark_decontamination":
            dirty = decontaminate.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct()
            assert counts[-1] == counts[-2] - dirty.count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    assert docs.where("text rlike '[a-z]@mail[0-9]'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ids = subwords.encode_ids(docs, corpus_pipeline.piece_model()).selectExpr("doc_id", "size(ids) as n")
    assert last.join(ids, "doc_id").where("n_tokens <> n").count() == 0 and last.count() == counts[-1]


def test_one_of_each_group_without_ids(spark):
    rows = [(None, "same text of four words"), (None, "same text of four words"), (5, "other text is here now"), (5, "other text is here now"), (2, "Other text is here now"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == [(2, "Other text is here now"), (7, ""), (None, "same text of four words")]
    assert simhash.keep_one(docs.where("false")).collect() == []


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def test_every_numbered_query_is_registered():
    names = [n.split("_")[0] for n in QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and ORACLES.keys() <= QUERIES.keys()


def test_nothing_else_imports_the_folder():
    from pathlib import Path

    root = Path(sys.modules["cairnspark"].__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_stages_take_null_texts_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0)], docs.schema)
    held = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), SF)
        assert none.count() == 0, name
        rows = stage(spark, held, SF)
        assert rows.columns == none.columns and rows.count() <= held.count(), name
        if name in ("benchmark_decontamination", "pii_redaction", "sentencepiece"):  # they drop no text for being empty
            assert rows.where("doc_id > 900000").count() == 2, name
