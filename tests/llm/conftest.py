import pytest

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog again and again.", "a"), (1, None, "a"), (2, "", None), (3, "   \n ", "b"),
    (4, "One two three", "b"), (4, "One two three", "b"), (5, "ONE two  three", None), (None, "no id here, none at all", "c"),
    (6, "word " * 30_000, "a"), (7, "é ñ 日本語。\r\n\tx\x00y", "c"), (8, "The quick brown fox jumps over the lazy dog again and again.", "a"),
]


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like those that operations add."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    extra = {c: f"'{c}!'" for c in ("row", "size", "score", "matches", "shard", "slot", "copies", "taken", "edits", "part", "node", "whole", "fingerprint", "n_chars")}
    return frame.selectExpr("*", *(f"{v} as {c}" for c, v in extra.items()))


@pytest.fixture
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def vocabulary():
    from opslens.llm.queries import vocabulary

    return vocabulary()
