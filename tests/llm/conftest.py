from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns that clash with results."""
    long_ = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
        (2, "THE QUICK brown fox jumps over the lazy dog and runs away.", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, "   \n\t ", "en", None),
        (6, long_, "en", "a"),
        (7, "Le renard brun saute par-dessus le chien paresseux.", "fr", "b"),
        (7, "Le renard brun saute par-dessus le chien paresseux.", "fr", "b"),
        (None, "a row without an id", None, "b"),
        (None, "a row without an id", None, "b"),
        (8, "write to jo.doe@mail.example.com or +1 (212) 555-0123 now", "en", "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("score", "kept", "digest", "row", "fp", "component", "grp", "spans", "label"):
        frame = frame.selectExpr("*", f"'x' AS {clash}")
    return frame


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
