"""Edge-case documents: nulls, empty and long texts, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, t long, uid string, spans long, quality long"

LONG = "word " * 30_000


def edge_documents(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id and some words"), (None, None), (4, LONG), (5, "x" * 60_000),
        (6, "a repeated row of seven words here"), (6, "a repeated row of seven words here"), (6, "another text under the same id here"),
        (7, "a repeated row of seven words here"), (8, "日本語 テキスト é ñ 🙂 \u0000 end"),
    ]
    return spark.createDataFrame([(i, t, None, None if i == 1 else "s", None, "k", 1, "u", 2, 3) for i, t in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
