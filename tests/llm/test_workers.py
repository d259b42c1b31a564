"""Python workers of the text operators' tasks."""

from tickloom.llm import bpe


def test_round_trip_takes_one_worker(spark):
    """A task encodes and decodes in one worker: a second one holds its own vocabulary beside the first."""
    texts = ["", None, "The cat's 12 hats.\n\n  naïve <|endoftext|> \x00 \U0001f600", " " * 70 + "\t\r\n\x0b\x85　end", "a" * 5000, "plain words, and more: words."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartition(2)
    assert bpe.round_trip(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_and_decode(docs).collect()}
    assert len(want) == 18 and got == want and all(got[i][1] == (t or "") for i, t in enumerate(texts * 3))
