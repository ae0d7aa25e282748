"""Defects of prompt and response pairs: empty, refusal, copy, language, truncated.

Each pair is judged on its own, so the work is one pass without a shuffle. A pushdown parser over fences, brackets, quotations,
markup and lists says whether a response that used up its tokens breaks off; greedy string tiling on words says how much of
prompt and response cover each other; a grammar of refusals (the writer, ability or permission or will, negation, a verb of
answering) looks at each sentence outside quotations; scripts and function words say which language a text is in.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import spread

#: Characters per token, and share of the limit from which a response has used it up.
CHARS_PER_TOKEN, USED_UP = 4, 0.8
#: Shortest tile in words; shares of response and prompt that tiles cover in a copy; words that may stand beside them.
TILE_WORDS, RESPONSE_SHARE, PROMPT_SHARE, BESIDE_WORDS = 3, 0.75, 0.5, 6
#: Fewest function words that name a response's language, and the largest share of them that the expected language may have.
LANGUAGE_WORDS, EXPECTED_SHARE = 2, 0.5

# ---------------------------------------------------------------- empty

_FENCE_LABEL = re.compile(r"^\s*(?:```|~~~)\s*[\w+-]*\s*$", re.M)


def is_empty(text: str | None) -> bool:
    """Null, or nothing beyond blanks, quotes, brackets, fences (with their language) and punctuation."""
    if text is None:
        return True
    text = _FENCE_LABEL.sub("", text)
    return not any(unicodedata.category(ch)[0] in "LN" or ord(ch) > 0x1F000 for ch in text)


# ---------------------------------------------------------------- quotations and sentences

_QUOTES = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|‹[^‹›]*›|\"[^\"\n]*\"|‘[^‘’\n]{3,}’(?!\w)|(?<!\w)'[^'\n]{3,}'(?!\w)")


def without_quotations(text: str) -> str:
    return _QUOTES.sub(" ", text)


_JSON_TEXT = re.compile(r'"(?:error|message|response|answer|text|content|description|reason|refusal)"\s*:\s*"((?:[^"\\]|\\.)*)"', re.I)


def prose_of(text: str) -> str:
    """The text itself, or the values of a JSON object or array."""
    body = re.sub(r"```\w*|~~~\w*", " ", text).strip()
    if body[:1] in "{[" and (found := _JSON_TEXT.findall(body)):
        return "\n".join(x.replace('\\"', '"').replace("\\n", "\n") for x in found)
    if len(body) > 1 and body[0] in "\"“„«'" and body[-1] in "\"”“»'" and not re.search(r"[\"“”„«»]", body[1:-1]):
        return body[1:-1]
    return body


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?…])[\"”»')\]]*\s+|\n+", text) if re.search(r"\w", s)]


# ---------------------------------------------------------------- refusal

# Verbs of answering by language; a refusal denies one of them of its writer.
_EN_TASK = r"(?:answer|assist|help|provide|offer|give|write|describe|discuss|share|produce|create|generate|make|comment|identify|name|guess|narrate|comply|fulfil+|do|support|respond|reply|summari[sz]e|translate|list|tell|talk|speak|go\s+into|continue|take\s+part|engage|disclose|reveal|cover|recommend|speculate|judge|say|(?:view|see|open|access|watch|read)\s+(?:\w+\s+)?(?:images?|pictures?|photos?|videos?|clips?|files?|links?|this|that|it))"
_EN_DONE = r"(?:given|provided|produced|written|made|offered|created|generated|answered|described|shared|supplied)"
_ADVERB = r"(?:\s+(?:really|simply|just|also|therefore|currently|unfortunately|sadly|ever|even|be\s+able\s+to))*"
# The clauses by which an answer is declined: agent, modality, negation, verb.
_DECLINE = re.compile(
    rf"""\b(?:i|we)(?:['’]m|['’]re|\s+am|\s+are)?{_ADVERB}\s+(?:can(?:no|['’ ]?)t|can\s+not|could\s*n['’]?t|could\s+not|won['’]?t|will\s+not|would\s*n['’]?t|would\s+not|do\s*n['’]?t|do\s+not|may\s+not|must\s+not|shall\s+not|should\s*n['’]?t|should\s+not|am\s+not\s+going\s+to){_ADVERB}\s+(?:be\s+)?(?:\w+ing\b|{_EN_TASK}\b)(?<!\bbe\sbeing)
      |\b(?:i|we)(?:['’]m|['’]re|\s+am|\s+are){_ADVERB}\s+(?:unable|not\s+(?:able|allowed|permitted|authori[sz]ed|comfortable|willing|going|in\s+a\s+position|supposed|equipped|designed))\b
      |\b(?:i|we){_ADVERB}\s+(?:must|have\s+to|need\s+to|will|shall)?{_ADVERB}\s*(?:decline|refuse|pass\s+on|abstain|refrain)\b|\b(?:i|we)\s+(?:['’]?m\s+|am\s+|are\s+)?declining\b
      |\b(?:i|we)\s+(?:have\s+)?(?:chosen?|choose|prefer|decided|opt(?:ed)?)\s+not\b|\b(?:i|we)(?:['’]d|\s+would)\s+(?:rather|prefer)\s+(?:not|to\s+not)\b
      |\b(?:i|we)\s+(?:do\s*n['’]?t|do\s+not)\s+(?:feel|think\s+i\s+(?:can|should)|have\s+(?:the\s+)?(?:ability|access|permission|means))
      |\b(?:it|this|that)\s+(?:would|is|['’]s|was)?\s*(?:not|n['’]t)\s+(?:be\s+)?(?:appropriate|possible|allowed|permitted|right\s+for\s+(?:me|us)|something\s+(?:i|we)|a\s+(?:topic|subject|question|request)\s+(?:i|we))|\b(?:it|this|that)(?:\s+is|['’]s)\s*n['’]?t\s+(?:appropriate|possible|something\s+(?:i|we)|allowed)
      |\b(?:that|this|it)(?:\s+is|['’]s)\s+not\s+something\s+(?:i|we)
      |\b(?:requests?|questions?|topics?|subjects?|this|that|it)\b[^.!?]{{0,40}}\b(?:(?:is|are|falls?|lies?|goes)\s+)?(?:off[\s-]limits|out\s+of\s+bounds|(?:outside|beyond)\s+(?:of\s+)?(?:what\s+(?:i|we)|my|our)|against\s+(?:my|the|our)\s+(?:rules|guidelines|polic\w+|instructions|principles)|violates?\s+(?:my|the|our))
      |\b(?:my|our|the)\s+(?:rules|guidelines|polic(?:y|ies)|instructions|principles|programming|training)\s+(?:keep|prevent|stop|forbid|do\s+not|don['’]t|prohibit|bar|rule\s+out)
      |\bno\s+(?:\w+\s+){{1,3}}(?:can|will|may|could|shall)\s+be\s+{_EN_DONE}\b
      |\bthere\s+is\s+no\s+way\s+for\s+(?:me|us)\b
      |\b(?:kann|können|darf|dürfen|möchte|möchten|werde|werden|muss|müssen|will|wollen)\s+(?:ich|wir)\b[^.!?]{{0,60}}\b(?:nicht|keine?[nrs]?|ablehnen)\b|\b(?:ich|wir)\s+(?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|wollen)\b[^.!?]{{0,60}}\b(?:nicht|keine?[nrs]?)\b|\b(?:muss|müssen)\b[^.!?]{{0,60}}\bablehnen\b|\bablehnen\b|\blehne[n]?\b[^.!?]{{0,40}}\bab\b
      |\b(?:mache|machen|gebe|geben|erteile|liefere|schreibe|beantworte|beschreibe|helfe|nenne|kommentiere|erstelle)\s+(?:ich|wir)\b[^.!?]{{0,30}}\b(?:nicht|keine?[nrs]?)\b|\b(?:ich|wir)\s+(?:mache|gebe|erteile|liefere|schreibe|beantworte|beschreibe|helfe|nenne|kommentiere|erstelle)n?\b[^.!?]{{0,30}}\b(?:nicht|keine?[nrs]?)\b
      |\b(?:ist|wäre)\s+(?:es\s+)?(?:mir|uns)?\s*(?:leider\s+)?(?:nicht\s+(?:möglich|erlaubt|gestattet)|unmöglich)|\bnicht\s+(?:behilflich|helfen)\b
      |\bje\s+(?:ne|n['’])\s*(?:peux|puis|suis|veux|dois|vais|souhaite|réponds|donne|fournis|décris)\b|\bje\s+(?:dois|préfère|suis\s+obligée?)\s+(?:de\s+)?(?:refuser|décliner|ne\s+pas)|\b(?:il\s+)?m['’]est\s+(?:impossible|interdit)|\bje\s+refuse\b|\bimpossible\s+de\s+(?:vous\s+aider|répondre|décrire)|\bnous\s+ne\s+pouvons\b|\brefuser\s+de\b
      |\bno\s+(?:puedo|podemos|me\s+es\s+posible|es\s+posible|estoy\s+(?:autorizad|en\s+condiciones)|voy\s+a|me\s+(?:está|corresponde)|doy|ofrezco|respondo)\b|\b(?:debo|tengo\s+que|prefiero)\s+(?:rechazar|declinar|no|negarme)|\bme\s+(?:niego|es\s+imposible)\b|\brechazar\s+esta\b
      |\bnon\s+(?:posso|possiamo|sono\s+in\s+grado|mi\s+è\s+possibile|intendo|sono\s+autorizzat)|\bmi\s+rifiuto\b|\bdevo\s+(?:rifiutare|declinare)
      |\bnão\s+(?:posso|podemos|consigo|estou\s+autorizad|sou\s+capaz|me\s+é\s+possível|vou\s+(?:responder|ajudar|escrever))|\b(?:devo|tenho\s+de|tenho\s+que)\s+recusar|\brecuso(?:-me)?\b
      |\b(?:kan|mag|wil|zal)\s+(?:ik|wij|we)\b[^.!?]{{0,50}}\b(?:niet|geen)\b|\b(?:ik|wij|we)\s+(?:kan|kunnen|mag|mogen|wil|zal)\b[^.!?]{{0,50}}\b(?:niet|geen)\b|\bik\s+weiger\b""",
    re.I | re.X,
)
# Openings of sentences around a refusal that are no answer: apology, thanks, offers and advice to ask elsewhere.
_COURTESY = re.compile(
    r"""^\W*(?:(?:i['’]?m|i\s+am|we\s+are|we['’]re)\s+(?:very\s+|so\s+|really\s+)?(?:sorry|afraid)|sorry|apologies|my\s+apologies|unfortunately|thank\s+you|thanks|i\s+(?:understand|apologi[sz]e|appreciate|hope|regret)|is\s+there\s+anything|let\s+me\s+know|if\s+you\s+(?:like|want|have|need)|as\s+an?\s+(?:ai|language|assistant)|hello|hi|dear|i\s+have\s+to\s+be\s+upfront
        |(?:please\s+|you\s+(?:can|could|may|might)\s+)?(?:try|ask|contact|consult|rephrase|choose|pick|refer|reach\s+out|feel\s+free|let\s+me|consider\s+asking)\b
      |es\s+tut\s+mir|tut\s+mir|leider|entschuldig|verzeih|danke|vielen\s+dank|bitte\s+(?:wenden|fragen|kontaktieren|versuchen)|kann\s+ich\s+(?:sonst|ihnen|dir|noch)|als\s+(?:sprachmodell|ki)|gibt\s+es\s+(?:sonst|noch)
      |(?:je\s+suis\s+)?(?:désolée?|navrée?)|malheureusement|merci|puis-je|veuillez|en\s+tant\s+que\s+(?:modèle|ia)|je\s+(?:regrette|comprends)|n['’]hésitez
      |lo\s+(?:siento|lamento)|lamentablemente|desafortunadamente|gracias|disculp|perdón|¿?\s*(?:puedo|hay\s+algo|le\s+puedo|te\s+puedo)|por\s+favor|como\s+modelo|como\s+ia
      |mi\s+(?:dispiace|scuso)|spiacente|purtroppo|grazie|(?:me\s+)?desculpe|infelizmente|sinto\s+muito|lamento|obrigad[oa]|helaas|het\s+spijt|bedankt|dank)""",
    re.I | re.X,
)
_BUT_ANSWERS = re.compile(r"\b(?:but|however|yet|still|aber|jedoch|mais|pero|ma|mas|maar)\b[,\s]+(?:the|it|this|there|here|a|der|die|das|es|hier|le|la|il|on|el|hay|se|de|het|o)\b[^.!?]*\b(?:is|are|shows?|seems?|looks?|ist|sind|zeigt|est|sont|montre|es|está|son|muestra|è|sono|é|são|zijn)\b", re.I)
#: Share of a sentence's words, function words left aside, that the prompt has too, from which it only says the prompt again.
_SAID_AGAIN = 0.66


def is_refusal(text: str, prompt: str | None = None) -> bool:
    """Declines and answers nothing: a declining sentence outside quotations, and else only courtesies or words of the prompt."""
    refused, asked = False, None
    for s in sentences(without_quotations(prose_of(text))):
        if _DECLINE.search(s):
            # "I cannot name the people, but the scene is clear." is a hedge: it counts as neither.
            but = _BUT_ANSWERS.search(s)
            if not but or _DECLINE.search(s[but.start() :]):
                refused = True
            continue
        if _COURTESY.search(s):
            continue
        asked = set(_words(prompt or "")) if asked is None else asked
        words = [w for w in _words(s) if w not in _WORD_LANGUAGES]
        if sum(w in asked for w in words) < _SAID_AGAIN * len(words):
            return False
    return refused


# ---------------------------------------------------------------- copy


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


class _Automaton:
    """Suffix automaton of a word sequence: the longest match that ends at each word of another one, in linear time."""

    def __init__(self, words: list):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words):
            cur = self._add(self.size[last] + 1, {}, i)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    clone = self._add(self.size[p] + 1, dict(self.next[q]), self.end[q])
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _add(self, size: int, nxt: dict[str, int], end: int) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def matches(self, words: list, skip: bytearray) -> Iterator[tuple[int, int, int]]:
        """(length, end in words, end in the automaton's words) of the longest match ending at each word that isn't skipped."""
        state, length = 0, 0
        for i, w in enumerate(words):
            if skip[i]:
                state, length = 0, 0
                continue
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                state, length = 0, 0
            if length:
                yield length, i, self.end[state]


def tile(prompt: list[str], response: list[str]) -> tuple[float, float, int]:
    """Shares of response and prompt covered by greedy tiles, longest first, and the response's words outside them.

    A word of either side belongs to one tile at most. Each round marks the longest tiles that don't meet; what they leave is matched again.
    """
    mine, theirs = bytearray(len(response)), bytearray(len(prompt))
    while True:
        # Marked words of the prompt match nothing.
        found = sorted(_Automaton([w if not theirs[j] else j for j, w in enumerate(prompt)]).matches(response, mine), key=lambda x: (-x[0], x[1]))
        if not found or found[0][0] < TILE_WORDS:
            break
        for length, i, j in found:
            if length < TILE_WORDS:
                break
            if mine.find(1, i - length + 1, i + 1) < 0 and theirs.find(1, j - length + 1, j + 1) < 0:
                mine[i - length + 1 : i + 1] = theirs[j - length + 1 : j + 1] = b"\1" * length
    return sum(mine) / max(1, len(response)), sum(theirs) / max(1, len(prompt)), len(response) - sum(mine)


def is_copy(prompt: str | None, text: str) -> bool:
    """Gives back the prompt or most of it and adds no answer; repeats of a paragraph count once."""
    if not prompt:
        return False
    parts = list(dict.fromkeys(p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()))
    p, r = _words(prompt), _words("\n".join(parts))
    if len(r) < TILE_WORDS or len(r) < PROMPT_SHARE * len(p) * 0.9:
        return False
    beside = max(BESIDE_WORDS, 0.1 * len(r))
    # Words that the prompt doesn't have are in no tile.
    known = set(p)
    others = sum(w not in known for w in r)
    if others > beside or others > (1 - RESPONSE_SHARE) * len(r):
        return False
    # A prompt given several times in a row is tiled against each of its copies.
    copies = max(1, round(len(r) / max(1, len(p))))
    mine, theirs, outside = tile(p * copies, r)
    return theirs >= PROMPT_SHARE and mine >= RESPONSE_SHARE and outside <= beside


# ---------------------------------------------------------------- language

# Function words by language.
_FUNCTION_WORDS = {
    "en": "the a an of and to in is that it was for on are with as his they at be this have from by but what we were all there your an which their if will then so her has more no who now its while near shows during into through between behind not you she he him them because after before over under when where how also".split(),
    "de": "der die das und ist nicht ein eine einem einen zu den dem mit sich auf für von im am an es er sie wir auch als aus bei nach wird sind war wie nur zur zum über vor danach steht zeigt bleibt um in was wo wer ich du ihr haben hat dass wenn noch oder aber kein keine unter zwischen durch".split(),
    "fr": "le la les un une des du de et est à au aux en dans que qui ne pas sur pour par avec il elle on nous vous ce cette ses ou mais se sont après avant pendant devant près ensuite je leur son sa plus comme tout être fait sans sous entre".split(),
    "es": "el la los las un una y es de del en que no se a al por con para su sus lo como más pero este esta hay está después antes durante desde hasta cerca sobre junto qué yo muy también cuando donde ser son fue entre sin".split(),
    "it": "il lo la i gli le un uno una di del della dei delle che è e non in nel nella con per su sul sulla da dal dalla al alla si sono come più ma questo questa anche quando dove essere era fra tra senza dopo prima davanti vicino".split(),
    "pt": "o a os as um uma de do da dos das e é não em no na nos nas que com para por se ao à como mais mas este esta também quando onde ser são foi entre sem depois antes perto sobre seu sua ele ela você".split(),
    "nl": "de het een en van is niet in op te dat die met voor zijn aan er als ook bij uit om naar dan maar of door over nog worden wordt was hij zij wij deze dit geen naast achter voordat tussen onder ik je".split(),
}
_WORD_LANGUAGES: dict[str, list[str]] = {}
for _language, _list in _FUNCTION_WORDS.items():
    for _word in dict.fromkeys(_list):
        _WORD_LANGUAGES.setdefault(_word, []).append(_language)
# Function words that are other words of another language.
_HOMOGRAPHS = frozenset("door van come dove die era men per as over was on me an in war so fin son sin sur mit am hat her den over dan die".split())
# Names of languages by which a prompt asks for one.
_LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|inglese|inglês|engels", "de": "german|deutsch|allemand|alemán|tedesco|alemão|duits", "fr": "french|französisch|français|francés|francese|francês|frans", "es": "spanish|spanisch|espagnol|español|castellano|spagnolo|espanhol|spaans",
    "it": "italian|italienisch|italien|italiano|italiaans", "pt": "portuguese|portugiesisch|portugais|portugués|portoghese|português|portugees", "nl": "dutch|niederländisch|néerlandais|neerlandés|olandese|holandês|nederlands",
}
_ASKED = re.compile(r"\b(?:in|into|auf|ins|en|to|em|het)\s+(?:the\s+)?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _LANGUAGE_NAMES.items()) + r")\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def asked_language(prompt: str) -> str | None:
    m = _ASKED.search(prompt)
    return m.lastgroup if m else None


@lru_cache(maxsize=None)
def _is_latin(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith("LATIN")


def function_words(words: list[str]) -> Counter:
    """How often each function word of any language is met; words in capitals are left aside, the part before an apostrophe counts too."""
    met: Counter = Counter()
    for w, n in Counter(words).items():
        if w.isupper() and len(w) > 1:
            continue
        w = w.lower()
        if w in _WORD_LANGUAGES:
            met[w] += n
        elif "'" in w or "’" in w:
            w = re.split(r"['’]", w)[0]
            if w in _WORD_LANGUAGES:
                met[w] += n
    return met


def language_scores(text: str) -> tuple[dict[str, float], int, float]:
    """Function words per language, each twice at most (one shared by n languages counts 1/n in each), words, share of letters beyond Latin script."""
    scores, _, words, far = _languages(text)
    return scores, words, far


def _languages(text: str) -> tuple[dict[str, float], Counter, int, float]:
    words = _LETTERS.findall(text)
    met = function_words(words)
    scores: dict[str, float] = {}
    for w, n in met.items():
        found = _WORD_LANGUAGES[w]
        for language in found:
            scores[language] = scores.get(language, 0.0) + min(n, 2) / len(found)
    joined = "".join(words)
    far = 0.0 if joined.isascii() else sum(n for ch, n in Counter(joined).items() if not _is_latin(ch)) / max(1, len(joined))
    return scores, met, len(words), far


def prompt_language(prompt: str) -> str | None:
    """The language asked for, or that of the instruction: lines of lists and their quotations left aside."""
    asked = asked_language(prompt)
    if asked:
        return asked
    lines = [x for x in prompt.split("\n") if not re.match(r"\s*(?:\d+[.)]|[-*•|])\s", x)]
    scores, _, _ = language_scores(without_quotations("\n".join(lines)))
    return max(sorted(scores), key=lambda k: scores[k]) if scores else None


def is_foreign(prompt: str | None, text: str) -> bool:
    """In another language than the prompt asks for or is in; quotations and words in capitals are left aside."""
    if not prompt:
        return False
    body = re.sub(r"^#+ .*$", " ", without_quotations(prose_of(text)), flags=re.M)
    scores, met, words, far = _languages(body)
    want = prompt_language(prompt)
    if not want:
        # No language is known by its words, but a script may be: a prompt beyond Latin script that is answered in Latin.
        return words >= 2 and far < 0.2 and language_scores(prompt)[2] > 0.5
    if far > 0.5 and words >= 2:
        return True
    if not scores:
        return False
    top = max(sorted(scores), key=lambda k: scores[k])
    foreign = {w: n for w, n in met.items() if want not in _WORD_LANGUAGES[w]}
    # A word that other languages have with another meaning names no language alone, however often it is there.
    if len(foreign) < 2 and (not foreign or not _HOMOGRAPHS.isdisjoint(foreign)):
        return False
    if top != want and scores[top] >= LANGUAGE_WORDS and scores.get(want, 0.0) <= EXPECTED_SHARE * scores[top]:
        return True
    # Words of languages that share them, but that the expected one doesn't have.
    return len(foreign) == len(met) and sum(min(n, 2) for n in foreign.values()) >= LANGUAGE_WORDS


# ---------------------------------------------------------------- truncated

_CLOSER = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "›": "‹"}
_END = re.compile(r"[.!?…。！？][\"'”“»’)\]*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")


_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)(?:\s[^<>]*)?(/?)>")
_FENCE = re.compile(r"[ \t]*(```+|~~~+)[^\n`]*(?=\n|$)")
_MARK = re.compile(r"[ \t]*(?:[-*•]|\d+[.)])(?=\s|$)")
_SINGLE = frozenset("br hr img p li input meta link".split())


def open_constructs(text: str) -> list[str]:
    """What a pushdown parser has on its stack at the end: fences, list marks without their text, brackets, quotations, tags.

    Strings hide what is in them, a fence that closes takes along what was open within it, and a bracket is closed by one of any kind, as
    that of an interval. Quotations of prose end with their line.
    """
    stack: list[str] = []
    i, n, structured, line = 0, len(text), bool(re.match(r"\s*(?:```\w*\s*)?[\[{]", text)), True
    while i < n:
        ch = text[i]
        if line:
            line = False
            if m := _FENCE.match(text, i):
                mark = m[1][0] * 3
                if mark in stack:
                    del stack[stack.index(mark) :]
                else:
                    stack.append(mark)
                i = m.end()
                continue
            if "```" not in stack and "~~~" not in stack and not structured and (m := _MARK.match(text, i)):
                if stack and stack[-1] == "-":
                    stack.pop()
                stack.append("-")
                i = m.end()
                continue
        if ch == "\n":
            line = True
        if stack and stack[-1] == "-" and not ch.isspace():
            stack.pop()  # the mark has its text
        top = stack[-1] if stack else ""
        if top == '"':
            if ch == "\\" and structured:
                i += 1
            elif ch == '"' or (ch == "\n" and not structured):
                stack.pop()
        elif ch == '"':
            stack.append('"')
        elif ch in "([{“„«‹" and not (ch == "“" and top == "„"):
            stack.append(ch)
        elif ch == "“" and top == "„":
            stack.pop()
        elif ch in _CLOSER:
            if top == _CLOSER[ch] or (ch == "”" and top == "„") or (top and top in "([{" and ch in ")]}"):
                stack.pop()
        elif ch == "<" and (m := _TAG.match(text, i)):
            if m[1]:
                if f"<{m[2]}>" in stack:
                    stack.remove(f"<{m[2]}>")
            elif not m[3] and m[2].lower() not in _SINGLE:
                stack.append(f"<{m[2]}>")
            i += len(m[0]) - 1
        i += 1
    return stack


def breaks_off(text: str) -> bool:
    """Whether a response stops unfinished: an open construct, a heading or list mark without its text, a line that just ends."""
    body = text.rstrip()
    if open_constructs(body):
        return True
    plain = re.sub(r"```\s*$", "", body).rstrip()
    last = plain.rsplit("\n", 1)[-1]
    if re.match(r"\s*#{1,6}\s", last) or re.fullmatch(r"\s*(?:[-*•]|\d+[.)])\s*", last):
        return True
    if plain[-1:] in "]}" and plain.lstrip("`jsonJSON \n")[:1] in "[{":
        return False
    if _ITEM.match(last):
        items = [x for x in plain.split("\n") if _ITEM.match(x)]
        dotted = sum(bool(_END.search(x)) for x in items[:-1])
        if _END.search(last) or re.search(r"[)\]”»\"]$", last):
            return False
        # Unpunctuated lists: an item is whole if it ends as another item does.
        tails = {tuple(_words(x)[-2:]) for x in items[:-1]}
        return bool(dotted) or tuple(_words(last)[-2:]) not in tails
    return not _END.search(last) and not re.search(r"[)\]”»\"]$", last)


def is_truncated(text: str, max_tokens) -> bool:
    """Breaks off unfinished, having used up its tokens; without a limit there is nothing to use up."""
    if max_tokens is None or max_tokens != max_tokens or max_tokens <= 0:
        return False
    return len(text) >= USED_UP * CHARS_PER_TOKEN * max_tokens and breaks_off(text)


# ---------------------------------------------------------------- operator


def defect_of(prompt: str | None, text: str | None, max_tokens) -> str | None:
    """The defect of a pair, the first that holds of empty, refusal, copy, language, truncated; None for a sound one."""
    if is_empty(text):
        return "empty"
    if is_refusal(text, prompt):
        return "refusal"
    if is_copy(prompt, text):
        return "copy"
    if is_foreign(prompt, text):
        return "language"
    return "truncated" if is_truncated(text, max_tokens) else None


def find_defects(df: DataFrame, key: str, prompt: str, response: str, max_tokens: str) -> DataFrame:
    """(key, defect STRING): one row per distinct key and defect; sound pairs give none.

    ``max_tokens`` is a column or field expression; null means no known limit, so no truncation. A null response is empty, a null
    prompt can be neither copied nor name a language. Null keys give no rows, repeated rows one; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defect_of(p, r, m) for p, r, m in zip(b.p, b.r, b.m.astype(object).where(b.m.notna(), None))]
            out = pd.DataFrame({"k": b.k, "defect": pd.Series(found, dtype=object, index=b.index)})
            yield out[out.defect.notna()]

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(prompt).alias("p"), F.col(response).alias("r"), F.expr(max_tokens).cast("double").alias("m"))
    return spread(rows).mapInPandas(run, f"k {kind}, defect string").distinct().withColumnRenamed("k", key)
