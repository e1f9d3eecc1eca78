"""No language is left out of the model."""

import pytest

from claimloom.llm import langid

WORDS = {"aa": "der hund und die katze", "bb": "the dog and the cat", "cc": "le chien et le chat"}


def test_more_languages_than_allowed_are_an_error(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(sorted(WORDS.items()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(docs, max_languages=2)
    assert langid.fit(docs, max_languages=3).languages == ["aa", "bb", "cc"]
