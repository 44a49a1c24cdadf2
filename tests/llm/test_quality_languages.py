from stratafolio.llm import quality_rules


def test_stop_words_are_asked_of_their_languages_only(spark):
    text = " ".join(f"slovo{k}" for k in range(80))
    rows = [(1, text, "cs"), (2, text, "en"), (3, text, None)]
    got = {r.row.doc_id: (r.kept, r.broken) for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: (True, []), 2: (False, ["stop_words"]), 3: (False, ["stop_words"])}
