"""Small tables for the corpus tests."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def make(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source); with an extra column."""
    full = [(r + (None, None))[:4] for r in rows]
    return spark.createDataFrame(
        [(i, t, lang, source, None if t is None else len(t), 0.5) for i, t, lang, source in full],
        SCHEMA,
    )
