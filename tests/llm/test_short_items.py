"""Benchmark items of fewer words than the shortest tile."""

from millrace.llm import decontaminate as B


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "so Quick, brown fox; ran"), (2, "quick brown"), (3, "one"), (4, None), (5, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "ONE"), (3, ""), (4, "a b c d e f"), (5, None), (6, "brown quick")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["item_words"], r["matched_words"], r["n_tiles"]) for r in B.contaminated(docs, items).collect()}
    assert got == {(1, 1, 3, 3, 1), (3, 2, 1, 1, 1), (5, 4, 6, 6, 1)}
    assert sorted(r["doc_id"] for r in B.drop_contaminated(docs, items).collect()) == [2, 4]
