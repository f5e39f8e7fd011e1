import corpus_pipeline


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mixing", "piece encoding"]
    from corpusmill.plans.scratch import materialize

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] > counts[3] * 0.9
    rows = corpus_pipeline.run(spark, small).collect()
    assert len(rows) == counts[4] and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def run_stages(spark, docs, folder):
    from corpusmill.plans.scratch import materialize

    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
    return corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_no_recurring_line_is_kept_by_a_later_document(spark, small):
    from corpusmill.llm import line_dedup

    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = line_dedup.line_decisions(docs).filter("sentence_no < 0 and not first").select("id", "print", "line_no").collect()
    assert once
    texts = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    kept = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.drop_lines(spark, docs, small).collect()}
    # a later occurrence is left in no document more often than documents of that text have it as a first one
    for r in once:
        line = texts[r.id][r.line_no]
        assert r.id not in kept or kept[r.id].count(line) < texts[r.id].count(line)


def test_odd_and_empty_documents(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = run_stages(spark, odd_docs.selectExpr("*", "'x' as row", "1 as score", "2 as n_copies"), str(tmp_path))
    # classes: blank texts by their letters, and each different text with words
    assert {r.doc_id for r in got} <= {None, 1, 2, 3, 4, 5} and all(r.n_tokens >= 2 for r in got)
    assert run_stages(spark, no_docs, str(tmp_path)) == []
