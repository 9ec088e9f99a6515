import corpus_pipeline as C


def test_stages_keep_columns_and_decide(spark, sf_dir, edge_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = spark.createDataFrame([(5001, "tiny", "en", "src0", 4), (5002, docs.orderBy("doc_id").first()["text"], "fr", "src1", 1), (5003, None, "en", None, 0)], docs.schema)
    now, sizes = docs.unionByName(planted), []
    for _, stage in C.STAGES[:-1]:
        now = C.materialize(stage(spark, now, sf_dir), "t")
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        sizes.append(now.count())
    left = {r["doc_id"] for r in now.collect()}
    assert not left & {5001, 5002, 5003} and 0 in left
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 0.7 * docs.count()
    places = C.STAGES[-1][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in places.select("doc_id").collect()} == left


def test_run_and_edges(spark, sf_dir, edge_docs, no_docs, tmp_path):
    assert C.run(spark, sf_dir).count() > 100
    for name, df in (("edges", edge_docs), ("none", no_docs)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = C.run(spark, f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in out.collect()} == ({5, 6, None} if name == "edges" else set())
