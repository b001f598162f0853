from reelmill.operators.lines import constant_rollup


def test_spellings_of_one_key_are_one_row(spark):
    """DuckDB gives two rows here: the HAVING of C5's SQL names an alias, which adds its column text to GROUP BY ALL."""
    lines = spark.createDataFrame([(1, 0, "The word!"), (1, 1, "The word"), (1, 2, "Other"), (2, 0, "The word")], "video_id long, line_no long, text string")
    got = sorted(map(tuple, constant_rollup(lines).select("video_id", "key", "text", "seen_count", "confidence").collect()))
    assert got == [(1, "other", "Other", 1, 0.675), (1, "the word", "The word!", 2, 0.9), (2, "the word", "The word", 1, 0.675)]
