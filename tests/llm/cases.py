"""Small tables that every operator has to stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, rule string"

LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))


def documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    texts = [None, "", " \n\t", "one", "Ünï cödé ▁ text  with  spaces", LONG, "a\nb\na\n", "the mit license here", "the mit license here"]
    rows = [(i, t, None if i % 2 else "en", None, None, i, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", "en", "s", 1, 1, None), (3, "one", None, None, None, 3, "x"), (3, "other", "en", "s", 5, 3, "x")]
    rows += [(100 + i, " ".join(f"tok{(i * j) % 50}" for j in range(60 + i)), "en", "s", 0, 0, "x") for i in range(40)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
