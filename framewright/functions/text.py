"""Text expressions on columns; all stay in the JVM unless the name says python."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no content when two texts are compared.
STOP_WORDS = (
    "the a an and or but of to in on at by for with from as is are was were be been it its this that these those there then than "
    "we our you your they their he she his her not no into out up down over under through video scene footage camera shot moment line"
).split()
#: Words that mark an advertisement or a ticket gate rather than signage.
SIGNAGE_STOP_WORDS = "experian credit score free forever find now massage massages ticket holders only awesome".split()
#: Real words that a lexicon must not rewrite.
LEXICON_STOP = "core water baker fore wine fine time more over fire care bore tide note none site side case".split()
#: Fixed value: a full-screen card that names a line.
TITLE_CARD = r"^[A-Z][A-Za-z& ]{2,28}\s+Line\s*$"

_ = lambda c: F.col(c) if isinstance(c, str) else c


def filled(c) -> Column:
    """Null as the empty text."""
    return F.coalesce(_(c), F.lit(""))


def stripped(c) -> Column:
    """Without blanks and line breaks at both ends; null as empty."""
    return F.regexp_replace(filled(c), r"^\s+|\s+$", "")


def tokens(c) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(filled(c)), F.lit("([a-z0-9]+)"), 1))


def content_words(c, min_len: int = 4) -> Column:
    """Distinct words of a-z with at least min_len letters that are no stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(filled(c)), F.lit("([a-z]+)"), 1))
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(*STOP_WORDS))


def word_list(c) -> Column:
    """Words of a-z and apostrophes in order, repeats kept."""
    return F.regexp_extract_all(F.lower(filled(c)), F.lit("([a-z']+)"), 1)


def jaccard(a, b, both_empty: float) -> Column:
    """Share of common elements of two arrays of distinct elements; ``both_empty`` where neither has any."""
    union = F.size(F.array_union(_(a), _(b)))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(_(a), _(b))) / union)


def caption_echoes_text(caption, ocr, threshold: float = 0.5) -> Column:
    """Whether a caption mostly repeats the text on the picture; false if either is empty."""
    a, b = tokens(caption), tokens(ocr)
    return (F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b, 0.0) >= threshold)


def occurrences(c, query: str) -> Column:
    """Non-overlapping occurrences of a literal, without case."""
    q = query.lower()
    text = F.lower(filled(c))
    return ((F.length(text) - F.length(F.replace(text, F.lit(q), F.lit("")))) / len(q)).cast("int") if q else F.lit(0)


def snippet(c, query: str, width: int = 60) -> Column:
    """Window around the first literal match: a third of the width before it, half of it after, with ellipses where cut."""
    text = filled(c)
    at = F.instr(F.lower(text), query.lower()) - 1
    start = F.greatest(F.lit(0), at - width // 3)
    end = F.least(F.length(text), at + len(query) + width // 2)
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.regexp_replace(F.substring(text, start + 1, end - start), r"^\s+|\s+$", ""), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, width)).otherwise(window)


def shortened(c, size: int = 80) -> Column:
    """The first ``size`` characters and an ellipsis where the text is longer."""
    text = filled(c)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def joined_document(*columns) -> Column:
    """Stripped non-empty texts joined by '. '."""
    return F.concat_ws(". ", *[F.nullif(stripped(c), F.lit("")) for c in columns])


def cited_seconds(c) -> Column:
    """All m:ss times of a text in order, in seconds."""
    text = filled(c)
    pattern = r"\b(\d{1,2}):([0-5]\d)\b"
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda m, s: m.cast("int") * 60 + s.cast("int"))


def without_blank_lines(c) -> Column:
    """Runs of blank lines as one, and no blanks at the ends of lines or of the text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(filled(c), r"[ \t]+(?=\r?\n|$)", ""), r"(?:\r?\n){3,}", "\n\n"), r"^\s+|\s+$", "")


def without_prefix(c, *prefixes: str) -> Column:
    """The stripped text without the first of the prefixes that it begins with, whatever their case."""
    pattern = "|".join(re.escape(p) for p in prefixes)
    return F.regexp_replace(stripped(c), rf"(?i)^(?:{pattern})\s*", "")


def split_sentences(c) -> Column:
    """Sentences, cut at blanks after . ! or ?"""
    return F.split(filled(c), r"(?<=[.!?])\s+")


def is_title_card(ocr, caption) -> Column:
    """A card that names a line, by its text or by how captions describe cards."""
    cap = F.lower(stripped(caption))
    return stripped(ocr).rlike(TITLE_CARD) | F.contains(cap, F.lit("black background")) | F.startswith(cap, F.lit("a title card that reads"))


def is_signage(c) -> Column:
    """Signage rather than noise: no advertising word, and capitals with a long word, or several long words of letters only."""
    text = stripped(c)
    words = F.split(text, r"\s+")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    advert = F.exists(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,:;'\"]+|[.,:;'\"]+$", "")).isin(*SIGNAGE_STOP_WORDS))
    shout = (capitals / letters >= 0.8) & F.exists(words, lambda w: F.length(w) >= 4)
    plain = (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{L}{5,}$"))
    return (F.length(text) >= 4) & (letters > 0) & ~advert & (shout | plain)


def keep_token(word, confidence, min_confidence: float = 60, min_len: int = 3) -> Column:
    """A confident token that is long enough and has a letter."""
    return (_(confidence) >= min_confidence) & (F.length(_(word)) >= min_len) & _(word).rlike(r"\p{L}")


def collapse_repetition(text: str, most: int = 4) -> str:
    """Python: the text cut back to the last sentence before the first run of more than ``most`` equal words."""
    words = text.split()
    plain = [w.lower().strip(".,!?") for w in words]
    run = 1
    for i in range(1, len(words)):
        run = run + 1 if plain[i] == plain[i - 1] else 1
        if run > most:
            kept = " ".join(words[: i - run + 1])
            cut = max(kept.rfind(x) for x in ".!?")
            return kept[: cut + 1] if cut >= 0 else kept
    return text


def first_json_array(text: str | None) -> str | None:
    """Python: the first top-level JSON array of a chatty text, in compact form; None where there is none that parses."""
    if not text:
        return None
    depth, start, quoted, escaped = 0, -1, False, False
    for i, ch in enumerate(text):
        # Brackets within the strings of an array don't count; quotation marks outside arrays are prose.
        if quoted:
            quoted, escaped = escaped or ch != '"', ch == "\\" and not escaped
        elif ch == '"' and depth:
            quoted = True
        elif ch == "[":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
            if depth == 0:
                try:
                    return json.dumps(json.loads(text[start : i + 1]), sort_keys=True, ensure_ascii=False)
                except ValueError:
                    return None
    return None


@F.pandas_udf(StringType())
def json_array_python(s: pd.Series) -> pd.Series:
    """Arrow batches of ``first_json_array``."""
    return pd.Series([first_json_array(t) if isinstance(t, str) else None for t in s], dtype=object)


@F.pandas_udf(StringType())
def without_repetition_python(s: pd.Series) -> pd.Series:
    """Arrow batches of ``collapse_repetition``; null stays null."""
    return pd.Series([collapse_repetition(t) if isinstance(t, str) else None for t in s], dtype=object)


def fuzzy_match_python(query: str, cutoff: float = 0.8):
    """Arrow UDF: whether some token of the text is close to some word of the query (ratio of matching blocks)."""
    wanted = query.lower().split() or [query.lower()]

    @F.pandas_udf("boolean")
    def near(s: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def hit(word: str) -> bool:
            if word not in known:
                known[word] = bool(difflib.get_close_matches(word, wanted, n=1, cutoff=cutoff)) or any(difflib.get_close_matches(q, [word], n=1, cutoff=cutoff) for q in wanted)
            return known[word]

        return pd.Series([isinstance(t, str) and any(hit(w) for w in t.lower().split()) for t in s], dtype=bool)

    return near


def snap_to_lexicon_python(lexicon: list[str], cutoff: float = 0.75, min_len: int = 4):
    """Arrow UDF: a noisy token as the closest lexicon word, in the token's case and with its outer punctuation."""
    canon = {w.lower(): w for w in lexicon}
    stop = set(LEXICON_STOP)

    def one(word: str | None) -> str | None:
        if word is None:
            return None
        core = "".join(ch for ch in word.lower() if "a" <= ch <= "z")
        if len(core) < min_len or core in canon or core in stop:
            return word
        near = difflib.get_close_matches(core, list(canon), n=1, cutoff=cutoff)
        if not near:
            return word
        ascii_letters = [i for i, ch in enumerate(word) if ch.isascii() and ch.isalpha()]
        found = canon[near[0]]
        found = found.upper() if word.isupper() else found[:1].upper() + found[1:] if word[:1].isupper() else found.lower()
        return word[: ascii_letters[0]] + found + word[ascii_letters[-1] + 1 :]

    @F.pandas_udf("string")
    def snap(s: pd.Series) -> pd.Series:
        return pd.Series([one(w) if isinstance(w, str) else None for w in s], dtype=object)

    return snap
