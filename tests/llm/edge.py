"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, score string, words string"


def documents(spark):
    long = " ".join(f"word{i % 977} part{i % 31}" for i in range(6000))
    texts = [
        (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, long),
        (7, "one two three four five six seven eight nine ten eleven twelve"), (7, "one two three four five six seven eight nine ten eleven twelve"),
        (None, "a text without an id but with ten words in all"), (8, "Héllo wörld ünd so weiter, ça va bien? größer été"), (9, "a b c d e " * 30), (10, "line again\nline again\n\nline again\nother"),
        (11, "odd\x1cseparators\x1f here <|endoftext|> and there   end"), (12, "x"),
    ]
    return spark.createDataFrame([(i, t, "en", None, None, "k", "s", None, "w") for i, t in texts], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
