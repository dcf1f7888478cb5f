"""Null and repeated ids in the stages that drop rows by doc_id."""


def test_null_and_repeated_ids_in_the_stages(spark):
    """As the stages' docstring says: null ids stay, a repeated id goes with all its rows."""
    import corpus_pipeline
    from rasterfold.llm.common import drop_ids
    from rasterfold.llm.exact_dedup import deduplicate

    a, b, c = (" ".join(f"{k}{n}" for n in range(20)) for k in "abc")
    docs = spark.createDataFrame([(None, a), (None, a), (5, a), (7, b), (7, c), (8, c)], "doc_id long, text string")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    ids = spark.createDataFrame([(None,), (7,)], "doc_id long")
    assert left(drop_ids(docs, ids)) == sorted([(None, a), (None, a), (5, a), (8, c)], key=repr)
    marks = {(r["doc_id"], r["group_size"], r["kept"]) for r in deduplicate(docs).filter("keep_id = 5").collect()}
    assert marks == {(None, 3, True), (5, 3, True)}
    assert left(corpus_pipeline.exact_dedup(spark, docs, "")) == sorted([(None, a), (None, a), (5, a), (8, c)], key=repr)
    near = docs.filter("doc_id is null or doc_id = 5")
    assert left(corpus_pipeline.near_dedup(spark, near, "")) == left(near)
