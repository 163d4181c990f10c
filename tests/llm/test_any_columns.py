"""Other columns of types that can't be ordered, and many rows without an id."""

from strophe.llm import exact_dedup, jaccard, mixing

DOCS = "doc_id long, text string, source string, tags map<string,string>"


def test_map_beside_the_texts(spark):
    text = "p q r s t u v w x y"
    rows = [(None, f"{text} {i}", "s", {"a": str(i)}) for i in range(30)]
    rows += [(1, text, "s", {"b": "1"}), (1, text, "s", {"b": "2"}), (2, text, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 31
    one = jaccard.keep_one(docs, width=5, num=60, den=100).collect()
    assert len(one) == 1 and one[0]["doc_id"] == 1 and one[0]["tags"] in ({"b": "1"}, {"b": "2"})
    assert mixing.mixed_documents(docs, block=7, shard=16).columns == docs.columns
    assert mixing.mixed_documents(docs, block=7, shard=16).count() > 0
