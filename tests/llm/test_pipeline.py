import corpus_pipeline as P
from cairn.llm import decontaminate, queries, simhash


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        kept[name] = docs.count()
        assert kept[name] <= before.count()
        if name == "near_dedup":
            left = simhash.near_duplicates(docs)
            assert left.where("doc_id <> component_id").count() == 0
        if name == "suffix_dedup":
            assert docs.where("length(text) <> n_chars").count() == 0
        if name == "decontaminate":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert kept["near_dedup"] < kept["quality"] < 200
    mixed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.count() == kept["decontaminate"] and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


def test_run_gives_the_last_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = P.run(spark, sf_dir)
    assert found.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    assert found.where("taken <> size * copies OR copies > 3").count() == 0 and 0 < found.count() < docs.count()


def test_empty_documents(spark, tmp_path, sf_dir):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
