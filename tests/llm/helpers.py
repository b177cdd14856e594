"""Small tables with everything that goes wrong in large ones."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog while seven small birds sing near an old stone bridge".split()


def awkward(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, columns whose names
    clash with those of the operators."""
    long_text = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 13) for i in range(20000))
    texts = ["", None, " ", "one", "one", "Ünï cödé ß 日本語 😀", long_text, " ".join(WORDS), " ".join(WORDS) + " today", "card 4111 1111 1111 1111 and a@b.org", "no letters: 123 !!", "\n\n"]
    rows = [(i, t, "en" if i % 2 else None, "src", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "src", 3), (None, "an id is missing", "en", None, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as fp", "'x' as word", "0.5 as score", "array(1) as pii", "0 as part", "'k' as key")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
