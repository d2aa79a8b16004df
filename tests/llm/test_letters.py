"""What counts as a letter for the language of a text."""

import unicodedata

import pytest

from leadtide.llm import language_id


@pytest.mark.parametrize(("text", "found"), [("", False), ("12 !", False), ("\u00b2 \u00bd", False), ("\u2167_3", False), ("\u00b2 a", True), ("\u6f22", True), ("\u00aa", True), ("\u0301", False), ("\u0e01", True)])
def test_letters(text, found):
    assert language_id.has_letter(text) == found


def test_letters_are_those_of_unicode():
    for k in range(0x30000):
        if not 0xD800 <= k < 0xE000:
            assert language_id.has_letter(chr(k)) == unicodedata.category(chr(k)).startswith("L")


def test_numbers_have_no_language(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(40)] + [(90, "\u00b2 \u00bd", "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    assert found[90] == "und" and found[1] == "en" and found[2] == "de"
