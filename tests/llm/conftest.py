import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, ties and repeated rows, and columns with names that operators use."""
    words = " ".join(f"word{k % 97} and{k % 31}" for k in range(20_000))
    rows = [
        (1, "Hello there, mail me at bob@example.com or +1 (234) 567-8901.", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"), (None, "no number here", "en"),
        (5, words, "en"), (6, "x" * 200_000, "en"), (7, "Hello there, mail me at bob@example.com or +1 (234) 567-8901.", "en"), (8, "1234 5678", None), (9, "Grüße aus München, déjà vu 🙂", "de"),
        (10, "Ünï▁code  double  spaces <|endoftext|> tail", "fr"), (11, "Hello there, mail me at bob@example.com or +1 (234) 567-8901.", "en"), (11, "Hello there, mail me at bob@example.com or +1 (234) 567-8901.", "en"),
    ]
    clash = [(*r, "src", "spans", 0.5, 7, 3) for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, spans string, score double, fp long, start int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
