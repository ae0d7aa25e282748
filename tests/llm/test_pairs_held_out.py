"""Defects in pairs of other wording and languages than the tables'."""

import pytest

from framewright.llm import pairs

ASK = "Write two sentences about the lift near the gate."
IT = "L'ascensore si trova vicino al cancello e non funziona. La gente aspetta davanti alla porta."
RU = "Лифт находится рядом с воротами и не работает сегодня утром. "


@pytest.mark.parametrize(
    "want, prompt, response",
    [
        ("refusal", ASK, "As an AI I don't provide this kind of content."), ("refusal", ASK, "This topic is off limits. Try another question."), ("refusal", "Beschreibe bitte die Szene am Tor.", "Dazu mache ich keine Angaben."),
        ("refusal", ASK, "I'm unable to assist with that request."), ("refusal", ASK, "We won't be answering that."), ("refusal", ASK, "My guidelines don't allow me to describe people."), ("refusal", ASK, "That's not something I'm comfortable writing about."),
        ("refusal", "Décris la scène.", "Je ne suis pas en mesure de répondre à cette demande."), ("refusal", "Describe la escena.", "Lo siento, no puedo ayudarte con eso."), ("refusal", "Schrijf over de lift.", "Helaas kan ik hier niet bij helpen."),
        ("refusal", "Descrivi la scena.", "Mi dispiace, non posso aiutarti con questa richiesta."), ("refusal", "Descreva a cena.", "Desculpe, não posso ajudar com isso."),
        (None, "Write a definition of recursion.", "I will not bore you: a function that calls itself."), (None, ASK, "I can't tell who it is, but the lift near the gate is out of order and people take the stairs."),
        (None, ASK, "The guard says he cannot help. The lift stays shut all day."), (None, ASK, "You cannot use the lift today. Take the stairs near the gate."),
        ("language", ASK, IT), ("language", ASK, "De lift staat naast de poort en is kapot. De mensen wachten voor de deur."), ("language", ASK, "O elevador fica ao lado do portão e não funciona. As pessoas esperam em frente."),
        ("language", "Write two sentences about the lift in Italian.", "The lift is at the end of the hall and it is out of order. People wait."), (None, "Write two sentences about the lift in Italian.", IT),
        ("language", ASK, "A sentence in English about the lift. " * 300 + RU * 2000), ("language", "Опиши лифт у ворот.", "The lift is at the end of the hall."), (None, "Опиши лифт у ворот.", RU),
        (None, "Name what is visible.", "- carriage door\n- carriage door\n- lost property desk"), (None, ASK, "The lift (a) stands still, so people climb."),
    ],
)
def test_other_wording(want, prompt, response):
    assert pairs.defect_of(prompt, response, 100000) == want


@pytest.mark.parametrize("text, stack", [("```\nfoo(\n```\nDone.", []), ("(a] b", []), ("```py\nx = [", ["```", "["]), ("One.\n- two\n- ", ["-"]), ("- one\n- two", []), ("see <b>bold", ["<b>"]), ("a <br> b", []), ('He said "no', ['"']), ('He said "no\nand left.', []), ("„so“ und «da", ["«"]), ("<" * 20000, [])])
def test_open_constructs(text, stack):
    assert pairs.open_constructs(text) == stack


def test_tiles_take_each_word_of_either_side_once():
    p = "a b c d e f g h".split()
    assert pairs.tile(p, p[:4] * 5) == (0.2, 0.5, 16)
    assert pairs.tile(p, "e f g h a b c d".split()) == (1.0, 1.0, 0)
    # A longer tile that takes away a part leaves the rest to the next round.
    assert pairs.tile("x a b c y a b c d".split(), "a b c d a b c".split()) == (1.0, 7 / 9, 0)
    assert pairs.is_copy("one two three four five", "one two three four five one two three four five") and not pairs.is_copy(" ".join(p * 3), " ".join(p[:4] * 5))
