"""Awkward rows that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, copy string, kept string"

ALPHA = " ".join(f"alpha{i} beta{i * 7 % 31} gamma{i * 3 % 17}" for i in range(40))


def awkward_docs(spark):
    long_text = " ".join(f"w{i * i % 997}x{i % 13}" for i in range(30_000))
    rows = [
        (1, ALPHA, "en", "a", 5, "x", "y", "z"), (1, ALPHA, "en", "a", 5, "x", "y", "z"), (2, ALPHA, None, None, None, None, None, None), (3, None, "en", "a", 0, None, None, None),
        (4, "", "en", "", 0, None, None, None), (5, " \n\t ", "en", "b", 3, None, None, None), (None, ALPHA + " tail", "en", "b", 3, None, None, None), (None, None, None, None, None, None, None, None),
        (6, long_text, "en", "b", 3, None, None, None), (7, "two words", "en", "b", 3, None, None, None), (8, "two words", "en", "b", 3, None, None, None), (9, "x" * 50_000, "en", "c", 1, None, None, None),
        (10, "mail bob@example.com or call +1 (319) 555-5132, card 4111 1111 1111 1111, host 10.0.0.1", "en", "c", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
