from rillsum.llm.common import written


def test_stages_run_in_order_and_take_effect(spark, sf):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[2] == counts[1] <= counts[0] and counts[3] <= counts[2]
    packed = C.STAGES[-1][1](spark, docs, sf)
    fill = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 2048


def test_registry_matches_the_contract():
    from rillsum.llm import registry

    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(registry.oracle_sql()) <= names
