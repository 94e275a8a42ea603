from notewright.llm import decontamination, pii, simhash


def test_stages_in_turn(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, small).cache()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
        ids, was = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (kept, before))
        assert ids <= was
        if i == 1:
            groups = simhash.simhash_groups(before).collect()
            assert ids == {r["component_id"] for r in groups}
        if i == 2:
            leaks = {r["doc_id"] for r in decontamination.find_leaks(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
            assert ids == was - leaks
        if i in (3, 4):
            assert ids == was
    assert pii.find_personal_data(kept).where("size(base) > 0").count() == 0
    whole = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and set(e.oracle_sql()) <= names


def test_imports_without_a_session():
    """The entry module is read before any session exists."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]


def test_oracle_has_the_operator_s_rules(spark):
    from notewright.llm import oracles, weak_supervision

    assert list(oracles._RULES) == list(weak_supervision.rules())
