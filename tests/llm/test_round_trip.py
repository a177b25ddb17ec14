from gridtally.llm import bpe


def test_round_trip_takes_one_worker_and_equals_both_steps(spark, odd_docs, no_docs):
    both = bpe.encode_and_decode(odd_docs)
    assert both.columns == ["doc_id", "ids", "n_tokens", "decoded", "valid"]
    as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert as_rows(both) == as_rows(bpe.decode(bpe.encode(odd_docs)))
    assert bpe.encode_and_decode(no_docs).collect() == []
    plan = bpe.round_trip(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
