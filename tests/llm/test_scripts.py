"""Shares of letters by script."""

from framewright.llm import pairs


def test_scripts_of_whole_text():
    assert pairs.language_scores("word " * 1000 + "слово " * 3000)[2] == 15000 / 19000
    assert pairs.language_scores("a" * 12 + "я" * 36)[2] == 0.75
    assert pairs.language_scores("")[2] == 0.0
