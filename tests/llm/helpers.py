WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sentence_text(rng, n):
    return " ".join(words(rng, rng.randint(6, 14)).capitalize() + "." for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=()):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "é", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def messy(spark, rng):
    """Nulls in any column, empty and blank texts, a long text, ties, repeated rows and ids."""
    base = sentence_text(rng, 8)
    texts = [base, base, None, "", " \n\t ", "one", sentence_text(rng, 900), base + " More words here.", "é ñ 日本 \U0001f600 " * 30, sentence_text(rng, 9)]
    extra = [(None, base, None, None, None), (None, None, None, None, None), (0, base, "en", "a", 1), (5, "another text with id five", "xx", "b", None)]
    return frame(spark, texts, extra)
