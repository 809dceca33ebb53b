import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all that is odd: nulls, no text, white space alone, repeated rows, other letters, a long text, clashing columns."""
    phrase = "The quick brown fox jumps over the lazy dog and runs far away from the old mill by the river"
    texts = [
        None, "", " \t\n\n\x0b ", "one", "Ünïcödé wörds ÀÉ and more “quoted” text — with dashes", phrase, phrase, phrase + " today", "\n".join([phrase] * 3 + ["short", ""]),
        phrase.upper(), "  " + phrase + "\r\nanother line that stands here alone and is long enough to be a key", "日本語 の テキスト 𝒳𝒴 é", "a\x00b c", phrase + "\n" + "x" * 3000, " ".join(f"w{k % 977}" for k in range(60000)),
    ]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "web", k, "mine", 0.5, 7, 1.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, lines string, score double, label int, rate double").repartition(3)


@pytest.fixture(scope="session")
def with_nulls(odd, spark):
    """odd with rows whose id is null, and with a row twice."""
    extra = spark.createDataFrame([(None, None, None), (None, "a row without id", "en")], "doc_id long, text string, lang string")
    return odd.unionByName(extra, allowMissingColumns=True).unionByName(odd.where("doc_id = 5"))
