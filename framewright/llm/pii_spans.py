"""Candidate spots of personal information and the labelers that vote on them.

Grammars propose spots generously; every labeler looks at a spot and votes for a type, for ``none``, or abstains. What the
votes are worth is not decided here: ``pii`` estimates it from the whole corpus. Cheap marks (an at sign, a cluster of digits, a house
number, a run of capitalised words) say where a grammar is tried at all; each is part of everything its grammar accepts, so
nothing is lost by them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

TYPES = ("name", "email", "phone", "id_number", "address")
NONE = "none"

#: Common given names, one labeler among others; ``spots_of`` takes a longer list as a parameter.
GIVEN = frozenset(
    """adam adrian ahmed aisha alan albert alejandro alex alexander alice amina amira amy ana andrea andreas andrew angela anita anna anne anneliese antonio arthur
    begoña benjamin benoît björn brian camille carla carlos carmen caroline catherine charles charlotte chloé christian christine claire clara claudia
    daniel daniela david diana diego elena elisabeth elizabeth emily emma eric étienne eva fatima felix fernando fiona francesca francisco frank françois friedrich
    george gérard giovanni giulia grace greta hannah hans hassan heike heinrich helen helena hélène henri henry hiroshi hugh ian inés ingrid íñigo irene isabel ivan
    jack jacek jacques jakob james jan jane javier jean jennifer joan johann john jorge josé juan julia jürgen karen karim karl käthe katherine kenji kofi kwame laura leila leonard
    linda louis louise luc luca lucas lucy lukas marco maria maría marie marta martha martin mary mathilde matthew matthias max mei michael miguel mohammed monica nadia nguyen nicolas nina noémie nora
    oliver oscar pablo patricia paul paula pedro peter philip pierre pilar piotr priya rachel raj ramón rebecca richard robert rosa ruth sabine samuel sandra sara sarah simon sofia stefan svetlana
    thomas tomasz ursula victor wei yuki yusuf yves zoe álvaro ángel""".split()
)
#: Endings that family names of several languages share.
FAMILY_ENDINGS = (
    "ley", "ell", "ova", "eva", "low", "beck", "ham", "iak", "wick", "ello", "ander", "ard", "quist", "well", "mann", "man", "eaux", "stad", "stadt", "ez", "sen", "son", "ski", "ska", "czyk", "wicz", "berg", "stein", "ton", "ford",
    "field", "mere", "er", "ov", "ev", "in", "ini", "etti", "elli", "escu", "sson", "enko", "yan", "ian", "ides", "opoulos", "oğlu", "wood", "worth", "croft", "strom", "ström", "lund", "dahl", "veld", "stra", "ema", "inho", "eira", "ira",
    "esi", "emi", "ah", "ou", "oto", "ura", "ada", "awa", "ito", "pra", "tel", "arma", "ingh",
)
#: Words that make a capitalised sequence a place, a line, a street or a firm.
PLACE_WORDS = frozenset(
    """line lines loop spur gate quay cross mill park vale bridge common junction station platform street road lane avenue ave st rd close terrace gardens court square way drive row place chapel church hill hills hall
    tunnel clock football club tours ltd limited llc inc corp gmbh ag sarl plc museum hotel bakery bank school college university hospital theatre market airport express tower house river lake mount mountain bay island city county
    section department ministry institute company society foundation association council committee office centre center bahnhof platz straße strasse allee weg rue calle plaza avenida via piazza estación gare linie ligne línea advert advertisement brand shop store""".split()
)
#: Function words of English, German, French and Spanish and titles of documents, which are no part of a name.
COMMON = frozenset(
    """the a an and or of on in at to for with from by is was are were be has had have who whose which that this these those it its as if then than over under near after before behind beside between into out off up down not no one two three
    we you he she they i my our your his her their there here when while where what how why because but so yes please hello dear hi thanks regards best sincerely subject re fwd note
    second sound camera mail phone tel e-mail email fax street late former per und oder der die das dem den des ein eine einem einer mit von auf zu zum zur im am ist sind war dann danach wer wie wo was
    et ou le la les un une des du de au aux dans sur sous pour par avec est sont puis ensuite y el los las una con por en del al su sus es está son luego después
    some each another both until while just only monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    national social insurance security identity driving tax passport licence license personal number kontakt adresse dirección formulaire formular formulario""".split()
)

_SP = r"(?:[ \t\u00a0]|\r?\n[> \t]*)"  # one blank or line break
_W = rf"(?:{_SP}{{1,3}})"
_S = rf"(?:[ \t\u00a0.\-–/]{{0,2}}(?:\r?\n[> \t]*)?)"  # optional separator within numbers
_UP = "".join(chr(c) for c in range(0x41, 0x590) if chr(c).isupper())  # capitals of Latin, Greek, Cyrillic and Armenian
_LO = "".join(chr(c) for c in range(0x61, 0x590) if chr(c).islower())

# ---------------------------------------------------------------- e-mail

_AT = r"(?:{s}?[@＠]{s}?|{s}?[\(\[\{{<]{s}?(?:at|AT|At|@|arobase|arroba|chiocciola){s}?[\)\]\}}>]{s}?)".format(s=_SP)
_DOT = r"(?:\.{n}?|{s}?[\(\[\{{]{s}?(?:dot|DOT|Dot|punkt|point|punto|\.){s}?[\)\]\}}]{s}?|{s}(?:dot|DOT){s})".format(s=_SP, n=r"(?:\r?\n[> \t]*(?=[a-z]))")
_BARE_DOT = rf"(?:\.|{_SP}?[\(\[\{{]{_SP}?(?:dot|DOT|Dot){_SP}?[\)\]\}}]{_SP}?|{_SP}(?:dot|DOT){_SP})"
_TLD = rf"(?:{_DOT}[A-Za-z0-9][\w-]*)*{_DOT}[A-Za-z]{{2,12}}(?![\w-])"
EMAIL = re.compile(
    rf"(?<![\w.+-])([A-Za-z0-9][\w+.'%-]*(?:{_SP}(?:dot|DOT){_SP}[\w+-]+)*)(?:{_AT}([A-Za-z0-9][\w-]*{_TLD})"
    rf"|{_W}(?:at|AT){_W}([A-Za-z0-9][\w-]*(?:{_BARE_DOT}[\w-]+)*{_BARE_DOT}[A-Za-z]{{2,12}})(?![\w-]))"
)
_AT_BRACKET = re.compile(rf"[\(\[\{{<]{_SP}?(?:at|AT|At|arobase|arroba|chiocciola){_SP}?[\)\]\}}>]")
_AFTER_AT = re.compile(rf"{_W}[A-Za-z0-9][\w-]*(?:\.[\w-]|{_SP}?[\(\[\{{]|{_SP}(?:dot|DOT)\s)")


def _at_marks(text: str) -> list[tuple[int, int]]:
    """Places of the signs and words that stand between the two parts of an address, in order."""
    out = [(i, i + 1) for sign in "@＠" if sign in text for i, ch in enumerate(text) if ch == sign]
    if any(b in text for b in "([{<"):
        out += [m.span() for m in _AT_BRACKET.finditer(text)]
    plain = text.replace("\n", " ").replace("\t", " ").replace("\u00a0", " ")
    for word in (" at ", " AT "):
        i = plain.find(word)
        while i >= 0:
            if _AFTER_AT.match(text, i + 3):
                out.append((i, i + 3))
            i = plain.find(word, i + 3)
    return sorted(out)


#: Endings of pictures and films, which are no domains.
_FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp mp mov avi tif".split())

# ---------------------------------------------------------------- phone and identity numbers

_PHONES = [
    rf"(?:\+|00(?=[1-9])){_S}\d{{1,3}}{_S}(?:\(0\){_S})?\(?\d{{1,4}}\)?(?:{_S}\d{{2,8}}){{1,5}}",
    rf"\(0\d{{1,4}}\){_S}\d{{3,8}}(?:{_S}\d{{3,6}})?",
    rf"\(\d{{2,3}}\){_S}\d{{3,5}}{_S}\d{{4}}",
    rf"(?:1{_S})?\d{{3}}[ .\-](?:\r?\n)?\d{{3}}[ .\-](?:\r?\n)?\d{{4}}",
    rf"0\d(?:[ .\-](?:\r?\n[> \t]*)?\d{{2}}){{4}}",
    rf"0\d{{2}}[ .\-](?:\r?\n[> \t]*)?\d{{3}}(?:[ .\-](?:\r?\n[> \t]*)?\d{{2}}){{2}}",
    rf"0\d{{2,4}}[ /\-](?:\r?\n[> \t]*)?\d{{3,6}}(?:[ \-](?:\r?\n[> \t]*)?\d{{3,6}})?",
    rf"0\d{{2,4}}\r?\n[> \t]*\d{{3,6}}(?:[ \-]\d{{3,6}})?",
    r"0\d{9,11}",
    r"(?<!\d )[6789]\d{4}[ \-]\d{5}",
    r"(?<!\d )[679]\d{2}[ .\-]?\d{3}[ .\-]?\d{3}",
]
PHONE = re.compile(r"(?<![\w@#])(?<!\d[.,/-])(?:" + "|".join(_PHONES) + r")(?![\w@])(?![.,/-]\d)")
_DIGIT_WORDS = "zero|oh|nought|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|double|triple|plus"
SPELT = re.compile(rf"(?<!\w)(?:{_DIGIT_WORDS})(?:[,.\-]?{_SP}{{1,2}}(?:{_DIGIT_WORDS})){{6,}}(?!\w)", re.I)
_DIGIT_SET = frozenset(_DIGIT_WORDS.split("|"))
_IDS = [
    rf"[A-Za-z]{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}[A-Da-d]",
    r"[A-Za-z]{2,5}9?\d{6,7}[A-Za-z]{2}\d[A-Za-z]{2}",
    r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    rf"\d{{3}}(?:[ \-]|{_SP})\d{{2}}(?:[ \-]|{_SP})\d{{4}}",
    rf"[12]{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d{{2}})?",
    r"[2-9]\d{3}[ \-]\d{4}[ \-]\d{4}",
    rf"\d{{2}}[ ](?:\r?\n[> \t]*)?\d{{3}}[ ](?:\r?\n[> \t]*)?\d{{3}}[ ](?:\r?\n[> \t]*)?\d{{3}}",
    rf"\d{{8}}{_S}[A-Za-z]",
    r"[XYZxyz]-?\d{7}-?[A-Za-z]",
    r"[A-Za-z]{6}\d\d[A-Za-z]\d\d[A-Za-z]\d{3}[A-Za-z]",
    r"[A-Za-z]{1,2}\d{6,9}[A-Za-z]?",
    r"[A-Za-z]\d{2,3}[A-Za-z]\d{2}[A-Za-z]\d",
    r"\d{8,12}",
]
IDENT = re.compile(r"(?<![\w@#])(?<!\d[.,/-])(?:" + "|".join(_IDS) + r")(?![\w@])(?![.,/-]\d)")
#: Five digits, each near the next: every phone and identity number holds such a cluster.
_DIGITS = re.compile(r"\d(?:[^\d\n]{0,3}(?:\r?\n[> \t]*)?\d){4,}")
_ACCOUNT = re.compile(r"\b[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\b")

# ---------------------------------------------------------------- address

_TYPE_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Terrace|Gardens|Court|Place|Way|Drive|Dr\.|Row|Square|Sq\.?|Crescent|Walk|Mews|Boulevard|Blvd\.?|Quay)"
_UNIT = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room){_SP}#?\d+[A-Za-z]?,?{_SP}{{1,2}})"
_A = "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
_OF = rf"(?:(?:de{_SP}la|de{_SP}los|de{_SP}l[’']|da|do|das|dos|del|della|delle|dei|di|des|du|de|d[’']){_SP}?)?"
ADDRESS = re.compile(
    rf"(?<![\w.,:/-])(?:{_UNIT}?\d{{1,5}}[A-Za-z]?,?{_SP}{{1,2}}(?:[NSEW]\.?{_SP})?(?:[{_A}][\w’'-]*{_SP}){{1,3}}?{_TYPE_EN}(?!\w)"
    rf"|\d{{1,4}}(?:{_SP}(?:bis|ter|quater))?,?{_SP}{{1,2}}(?:rue|avenue|av\.|boulevard|bd|impasse|place|chemin|allée|quai|cours|route|passage|square){_SP}{_OF}[{_A}][\w’'-]+"
    rf"|(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía|Carrer|Rua|Travessa|Via|Viale|Corso|Piazza|Vicolo|ul\.|al\.|pl\.|ulica|aleja){_SP}?{_OF}[{_A}][\w’'-]+(?:{_SP}[{_A}][\w’'-]+){{0,2}}?,?{_SP}(?:n\.?º?{_SP}?)?\d{{1,4}}"
    rf"|[{_A}][\w-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|graben|ring|ufer|damm|straat|laan|plein|gracht|kade|gatan|vägen|gata|vej|gade|veien){_SP}\d{{1,4}}[a-z]?(?!\w)"
    rf"|(?:[{_A}][\w-]+er|[{_A}]\w+){_SP}(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring){_SP}\d{{1,4}}[a-z]?(?!\w))",
    re.I,
)
_ADDR_TAIL = re.compile(rf"(?:,?{_SP}{{1,2}}(?:(?:Apt\.?|Flat|Unit|Suite){_SP}?#?|#)\d+[A-Za-z]?|,?{_SP}\d{{1,2}}\.?º(?:{_SP}\w{{1,4}}\b\.?)?)?(?:,{_SP}\d{{5}}{_SP}[{_UP}][\w-]+|,{_SP}[{_UP}][\w-]{{3,}}(?!\w))?(?:{_SP}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_SP}\d[A-Z]{{2}}(?!\w))?")
_GERMAN_LEAD = re.compile(rf"(?:Am|Im|An{_SP}der|An{_SP}den|Auf{_SP}der|Auf{_SP}dem|Zum|Zur|Unter{_SP}den|Beim){_SP}$", re.I)
#: A house number alone, as a mark; the words around it must hold a type of street.
_HOUSE = re.compile(r"\d(?<![\d:.].)\d{0,4}(?![\d:])", re.S)
_RIGHT_TYPES = frozenset("street st road rd avenue ave lane ln close terrace gardens court place way drive dr row square sq crescent walk mews boulevard blvd quay rue av bd impasse chemin allée quai cours route passage".split())
_LEFT_TYPES = frozenset("calle c avda avenida plaza pza paseo camino ronda travesía carrer rua travessa via viale corso piazza vicolo ul al pl ulica aleja straße strasse str weg allee platz gasse ring".split())
_LEFT_ENDINGS = ("straße", "strasse", "str", "weg", "allee", "platz", "gasse", "graben", "ring", "ufer", "damm", "straat", "laan", "plein", "gracht", "kade", "gatan", "vägen", "gata", "vej", "gade", "veien")
_PLAIN_WORDS = re.compile(r"[^\W\d_]+")

# ---------------------------------------------------------------- name

_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Sig|Dott|Pan|Pani|M)\.?"
_N = r"(?:[ \t\u00a0]{1,3}(?:\r?\n[> \t]*)?|\r?\n[> \t]*)"  # between the words of a name: one line break at most
_PARTICLE = r"(?:van der|van den|van|von der|von|vom|zu|de la|de los|del|della|de|da|dos|di|le|la|el|al|bin|ibn|ten)"
_PART = rf"(?:{_PARTICLE.replace(' ', _W)}{_W})"
_LETTER = r"[^\W\d_]"
_FAMILY = rf"(?:(?:Mac|Mc|O['’]|D['’])?{_LETTER}{{2,}}(?:['’]{_LETTER}+)?(?:-(?:\r?\n[> \t]*)?(?:Mac|Mc|O['’])?{_LETTER}{{2,}})?)"
_CAPITAL = rf"(?:(?:Mac|Mc|O['’]|D['’])?[{_UP}]{_LETTER}+(?:['’]{_LETTER}+)?(?:-(?:\r?\n[> \t]*)?[{_UP}]{_LETTER}+)?)"
#: A run of capitalised words and initials, with particles between.
RUN = re.compile(rf"[{_UP}](?<![\w@.+/#-][\s\S])(?:\.|['’]?{_LETTER}+(?:['’]{_LETTER}+)?(?:-(?:\r?\n[> \t]*)?[{_UP}]{_LETTER}+)?)(?:{_N}?(?<=[\s.]){_PART}?(?:[{_UP}]\.|{_CAPITAL}))+(?![\w@+/])")
_PIECE = re.compile(rf"[{_UP}]\.|{_FAMILY}")
_PARTICLES = frozenset(re.findall(r"\w+", _PARTICLE)) - {"M"}
NAME_BACK = re.compile(rf"([{_UP}](?<![\w@.+-][\s\S])['’]?{_LETTER}+(?:['’]{_LETTER}+)?(?:-(?:\r?\n[> \t]*)?[{_UP}]{_LETTER}+)?),{_N}({_CAPITAL}|[{_UP}]\.(?!\w))((?:{_N}[{_UP}]\.)*)(?![\w@+])")
_PART_LEFT = re.compile(rf"(?<!\w){_PART}$")
_LOWER_WORDS = re.compile(r"[a-zß-öø-ÿ]{3,}")

# ---------------------------------------------------------------- context

_NO = r"\W{0,3}(?:no|nr|nº|n°|number|num|numéro|nummer|número)?\W{0,4}$"
_PHONE_CUE = re.compile(r"(?:call|phone|phones|telephone|tel|tél|telefon|teléfono|telefono|téléphone|mobile|mobil|móvil|handy|fax|voicemail|ring|dial|text|sms|whatsapp|text me|reach me on|reached (?:at|on)|joignable au|erreichbar unter|localiza en el|portable|cell)\W{0,4}(?:no|nr|number|num|on|at|from|me)?\W{0,4}$", re.I)
_ID_CUE = re.compile(
    r"(?:passport|passeport|reisepass|pasaporte|passaporto|licen[cs]e|führerschein|permis|carnet|insurance|versicherung\w*|insured as|social(?: security)?|soc\. ?sec\.|ssn|nino|ni|ausweis\w*|personalausweis|identity card|id card|steuer-?id\w*|tax(?: id)?|utr|d\.?n\.?i\.?|n\.?i\.?f\.?|n\.?i\.?e\.?|nir|sécurité sociale|seguridad social|carte d[’']identité|codice fiscale|cni|pps|cpf|bsn|pesel|aadhaar)" + _NO,
    re.I,
)
_BAD_CUE = re.compile(
    r"(?:ticket|locker|car(?: number)?|part(?: no)?|drawing|checksum|asset|crop|build|invoice|serial|order|frame|reel|item|model|batch|version|scene|face|track|hash|id|isbn|iban|account|encoded on|fps|stock|train|clip|code|platform|wagon|unit no)[ :#-]{0,3}(?:(?:no|nr|number|num)\.?)?[ :#-]{0,3}$", re.I
)
_UNIT_AFTER = re.compile(r"^\W{0,3}(?:bytes|fps|px|kb|mb|gb|seconds|frames|sheet|mm|cm|km|kg|%|€|\$|£)(?:\b|(?<=\W))", re.I)
_NAME_CUE = re.compile(
    r"(?:\b(?:by|with|for|is|was|late|name|nom|nombre|speaker|cc|von|par|por|da|di|contact|kontakt|contacto|dear|liebe|lieber|cher|chère|estimado|hi|hello|from|and|witness|signed|attn|c/o|regards|guest|author|autor|auteur|according to|interview with|bild|pantalla|image|unterschrieb|firmó|signé|camera|sound)\W{0,3})$", re.I
)
_SIGN_CUE = re.compile(r"\b(?:signed|recorded|filmed|photographed|written|shot|directed|gefilmt|aufgenommen|grabado|filmé|signé|filmato|firmado) (?:by|von|por|par|da)\W{0,3}$|\b(?:unterschrieb|firmó|name|speaker|sprecher|interview with|interview mit|entretien avec)\W{0,3}$", re.I)
_NAME_AFTER = re.compile(r"^(?:[ ]?[(,–-]+[ ]?[(<+\d\w]|\s*\n|\s*$|[.!)]|\W{0,3}(?:e-?mail|mail|phone|tel|tél|said|says|who|qui|der|die|quien)\b)", re.I)
_ADDR_CUE = re.compile(r"(?:lives at|live at|resides at|residing at|address|adresse|anschrift|domicilio|dirección|indirizzo|adres|wohnhaft(?: in)?|wohnt(?: in)?|moved to|goes to|sent to|send to|post(?:ed)? to|collected from|studio|label shows|met at|invoice|paket an|colis au|paquete a|deliver(?:ed)? to|home|at home|habite(?: au)?|demeurant(?: au)?|vive en|abita in|mieszka przy)\W{0,4}$", re.I)
_ADDR_AFTER = re.compile(r"^(?:\s{2}|,?\s{1,3}(?:Apt|Flat|#|Unit)|\s?,?\s{1,3}[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b|,\s{1,3}\d{5}\b|,\s{1,3}[A-ZÀ-Þ][\w-]+|\)|\s*\n|\s*$|,\s?\d)", re.I)
_ADDR_BAD_BEFORE = re.compile(r"(?:exit|entrance|platform|trains? at|gate|stop|next stop is|people on the|line|scene|reel|car|coach)[ :#-]{0,3}(?:no\.?)?[ :#-]{0,3}$", re.I)
_ADDR_BAD_AFTER = re.compile(r"^\s{0,3}(?:side|sidings|platform|station|line|exit|entrance|stop|depot|branch)\b", re.I)


@dataclass
class Spot:
    """A candidate: its family of types, its place in the text, the labelers' votes and its words of context."""

    family: str
    start: int
    end: int
    votes: dict[str, str]
    words: list[str]
    #: The words of a name whose given name is on no list, which the corpus may show to be a fixed phrase.
    phrase: str | None = None


def _left(text: str, at: int, size: int = 40) -> str:
    part = text[max(0, at - size) : at]
    if "\n" in part:
        part = re.split(r"\n[> \t\r]*\n", part)[-1]
    return re.sub(r"\s*\n[> \t]*|\s+", " ", part)


def _right(text: str, at: int, size: int = 34) -> str:
    return text[at : at + size]


def _first(text: str, start: int, end: int) -> int:
    """Place of the first letter or digit of a spot."""
    while start < end and not text[start].isalnum():
        start += 1
    return start


def _shape(s: str) -> str:
    s = re.sub(r"\d", "9", s)
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", s)
    return re.sub(r"\s+", " ", re.sub(r"([Aa])\1{2,}", r"\1\1", s))[:28]


def _context(left: str, right: str) -> list[str]:
    lw = _PLAIN_WORDS.findall(left.lower())[-3:]
    rw = _PLAIN_WORDS.findall(right.lower())[:2]
    return [f"l{len(lw) - i}:{w}" for i, w in enumerate(lw)] + [f"r{i}:{w}" for i, w in enumerate(rw)]


# ---------------------------------------------------------------- check digits


def _luhn_like(digits: str, weights: list[int], modulus: int) -> int:
    return sum(int(a) * w for a, w in zip(digits, weights)) % modulus


def _verhoeff(digits: str) -> bool:
    """Check digit over the dihedral group of ten elements."""
    mul = lambda a, b: (a + b) % 5 + 5 * (b // 5) if a < 5 else (a - b) % 5 + 5 * (1 - b // 5)
    c = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch)
        for _ in range(i % 8):
            v = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[v]
        c = mul(c, v)
    return c == 0


def checked_number(plain: str) -> bool:
    """Whether the check digits of some state's number hold; plain: capitals and digits only."""
    if re.fullmatch(r"\d{11}", plain):
        first = _luhn_like(plain, list(range(10, 1, -1)), 11)
        second = _luhn_like(plain, list(range(11, 1, -1)), 11)
        cpf = int(plain[9]) == (0 if first < 2 else 11 - first) and int(plain[10]) == (0 if second < 2 else 11 - second) and len(set(plain)) > 1
        product = 10
        for ch in plain[:10]:
            product = ((int(ch) + product) % 10 or 10) * 2 % 11
        return cpf or (plain[0] != "0" and (11 - product) % 10 == int(plain[10]))
    if re.fullmatch(r"[2-9]\d{11}", plain):
        return _verhoeff(plain)
    if re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", plain):
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(plain[:8].translate(str.maketrans("XYZ", "012"))) % 23] == plain[8]
    if re.fullmatch(r"[12]\d{14}", plain):
        return 97 - int(plain[:13]) % 97 == int(plain[13:])
    return False


def _is_account(text: str, start: int, end: int) -> bool:
    """Whether a number is part of an international account number, whose check digits hold."""
    for m in _ACCOUNT.finditer(text, max(0, start - 30), min(len(text), end + 30)):
        if m.start() < end and m.end() > start:
            plain = m[0].replace(" ", "")
            if len(plain) >= 15 and int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 == 1:
                return True
    return False


# ---------------------------------------------------------------- labelers by family


def _email(text: str, m: re.Match, common: frozenset) -> Spot:
    local, domain = m[1], m[2] or m[3]
    left, right = _left(text, m.start()), _right(text, m.end())
    spelt = not re.search(r"[@＠]", m[0])
    bare = m[3] is not None
    tail = re.split(r"[^A-Za-z0-9]+", domain)[-1].lower()
    votes = {
        "mail_sign": "email" if not spelt else "",
        "mail_ending": "email" if re.fullmatch(r"[a-z]{2,8}", tail) and tail not in _FILE_ENDINGS else NONE,
        "mail_dotted": "email" if re.search(r"[.＠@(\[{]|dot", domain + m[0][len(local) :], re.I) and len(domain) > 4 else NONE,
        "mail_spelt": "" if not bare else ("email" if re.search(r"\Wdot\W", m[0], re.I) or re.search(r"[\d_+.]", local) else NONE),
        "mail_space_sign": NONE if re.search(r"\s[@＠]\s", m[0]) and re.match(r"(?i)\w+\s+\d", _right(text, m.end() - len(domain))) else "",
        "mail_word_local": NONE if bare and (local.lower() in COMMON or local.lower() in common) else "",
        "mail_cue": "email" if re.search(r"(?:mail|mailto|contact|contacto|kontakt|write to|address is|reply-to|requested by|forwarded from|questions|cc|escribir a|écrire à|schreiben|scrivere a|<|\()\W{0,4}$", left, re.I) else "",
        "mail_scale": NONE if re.match(r"\d+[a-z]?(?:\W|$)", domain) else "",
        "mail_handle": NONE if re.search(r"handle\W*$", left, re.I) else "",
    }
    return Spot("email", m.start(), m.end(), votes, _context(left, right) + [f"tld:{tail}"])


def _phone(text: str, m: re.Match) -> Spot:
    left, right, s = _left(text, m.start()), _right(text, m.end()), m[0]
    digits = re.sub(r"\D", "", s)
    cue = bool(_PHONE_CUE.search(left))
    votes = {
        "tel_form": "phone" if 9 <= len(digits) <= 14 and re.match(r"\+|00|\(0|0[1-9]|\(\d{2,3}\)|(?:1[ .-])?\d{3}[ .-]", s) else "",
        "tel_fours": NONE if re.fullmatch(r"\d{4}(?:[ \-]\d{4})+", s) else "",
        "tel_cue": "phone" if cue else "",
        "tel_id_cue": NONE if _ID_CUE.search(left) else "",
        "tel_thing": NONE if _BAD_CUE.search(left) else "",
        "tel_unit": NONE if _UNIT_AFTER.search(right) else "",
        "tel_social": NONE if re.fullmatch(r"\d{3}\D\d\d\D\d{4}", s) else "",
        "tel_date": NONE if re.fullmatch(r"\d{4}-\d\d-\d\d", s) else "",
        "tel_plain": NONE if re.fullmatch(r"\d+", s) and not s.startswith("0") and not cue else "",
        "tel_short": NONE if not 9 <= len(digits) <= 14 else "",
        "tel_account": NONE if _is_account(text, m.start(), m.end()) else "",
        "tel_checked": NONE if not s.startswith(("+", "0", "(")) and not cue and checked_number(digits) else "",
    }
    return Spot("phone", m.start(), m.end(), votes, _context(left, right) + ["shape:" + _shape(s)])


def _spelt(text: str, m: re.Match) -> Spot:
    left, right = _left(text, m.start()), _right(text, m.end())
    n = len(re.findall(r"\w+", m[0]))
    votes = {"spelt_length": "phone" if 9 <= n <= 16 else NONE, "tel_cue": "phone" if _PHONE_CUE.search(left) else "", "spelt_words": "phone"}
    return Spot("phone", m.start(), m.end(), votes, _context(left, right) + ["shape:words"])


def _ident(text: str, m: re.Match) -> Spot:
    left, right, s = _left(text, m.start()), _right(text, m.end()), m[0]
    plain = re.sub(r"[^0-9A-Za-z]", "", s).upper()
    known = (
        re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", plain) or re.fullmatch(r"[A-Z]{2,5}9?\d{6,7}[A-Z]{2}\d[A-Z]{2}", plain) or re.fullmatch(r"\d{3}-\d\d-\d{4}|\d{3}\.\d{3}\.\d{3}-\d\d", s)
        or (re.fullmatch(r"[12]\d{12,14}", plain) and not re.fullmatch(r"\d+", s)) or re.fullmatch(r"\d{8}-?[A-Z]", s.upper()) or re.fullmatch(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]", plain)
    )
    cue = bool(_ID_CUE.search(left))
    votes = {
        "id_cue": "id_number" if cue else "",
        "id_form": "id_number" if known else "",
        "id_checked": "id_number" if checked_number(plain) else "",
        "id_thing": NONE if _BAD_CUE.search(left) and not cue else "",
        "id_unit": NONE if _UNIT_AFTER.search(right) else "",
        "id_tel_cue": NONE if _PHONE_CUE.search(left) else "",
        "id_no_cue": "" if cue else NONE,
        "id_account": NONE if _is_account(text, m.start(), m.end()) else "",
    }
    return Spot("id_number", m.start(), m.end(), votes, _context(left, right) + ["shape:" + _shape(s)])


def _address(text: str, m: re.Match) -> Spot:
    start = m.start()
    lead = _GERMAN_LEAD.search(text[max(0, start - 14) : start])
    if lead and m[0][0].isalpha():
        start -= len(lead[0])
    left, right, s = _left(text, start), _right(text, m.end()), m[0]
    words = [w for w in _PLAIN_WORDS.findall(s.lower()) if len(w) > 1]
    tail = _ADDR_TAIL.match(text, m.end())
    clock = re.search(r"\d:\d{2}\W*$", left) or re.search(r"\d:$", text[max(0, start - 3) : start])
    votes = {
        "addr_cue": "address" if _ADDR_CUE.search(left) else "",
        "addr_after": "address" if _ADDR_AFTER.search(right) else "",
        "addr_form": "address",
        "addr_place": "address" if re.search(r"\b(?:at|to|in|from|an|in der|au|à|en|a|presso)\W{0,2}$", left, re.I) else "",
        "addr_list": "address" if re.search(r"[^\W\d_]{3,}(?:,|\s[-–])\s$|\($", left) else "",
        "addr_rail": NONE if _ADDR_BAD_BEFORE.search(left) or _ADDR_BAD_AFTER.search(right) else "",
        "addr_quay": NONE if words and words[-1] == "quay" else "",
        "addr_unit": "address" if re.match(_UNIT, s, re.I) else "",
        "addr_words": NONE if set(words[:-1]) & (COMMON | PLACE_WORDS) and not (words and words[0] in _LEFT_TYPES | _RIGHT_TYPES) else "",
        "addr_clock": NONE if clock else "",
        "addr_line_break": NONE if re.search(r"^\d{1,2}\s*\n", s) and not _ADDR_CUE.search(left) else "",
    }
    return Spot("address", start, tail.end() if tail else m.end(), votes, _context(left, right) + [f"type:{words[-1] if words else ''}"])


def _name(text: str, start: int, end: int, given: str, family: str, middle: bool, known: bool, common: frozenset, left: str, titled: bool) -> Spot:
    g, f = unicodedata.normalize("NFC", given).lower().rstrip("."), unicodedata.normalize("NFC", family).lower()
    initial = given.endswith(".")
    right = _right(text, end)
    following = re.match(r"\s+([^\W\d_]+\.?)", right)
    next_word = following[1].lower().rstrip(".") if following else ""
    mixed, shout = given[0].isupper() and family[0].isupper(), family.isupper() and given.rstrip(".").isupper()
    ending = re.split(r"[-\s]+", f)[-1].endswith(FAMILY_ENDINGS)
    plain = f.split("-")[-1]
    votes = {
        "name_given": "name" if known else "",
        "name_ending": "name" if ending else "",
        "name_cue": "name" if _NAME_CUE.search(left) else "",
        "name_title": "name" if titled else "",
        "name_sign": "name" if _SIGN_CUE.search(left) else "",
        "name_after": "name" if _NAME_AFTER.search(right) else "",
        "name_case": "" if shout else ("name" if mixed else NONE),
        "name_middle": "name" if middle else "",
        "name_plain": NONE if not known and not initial and not titled else "",
        "name_place": NONE if f in PLACE_WORDS or g in PLACE_WORDS or next_word in PLACE_WORDS else "",
        "name_common": NONE if f in COMMON or (g in COMMON and not initial) else "",
        "name_lower": NONE if plain in common or (not known and not initial and g in common) else "",
        "name_id": NONE if initial and re.search(r"[A-Z]{2}\W?\d\d\W?\d\d\W?\d\d\W{1,2}$|\dº\W$", left) else "",
        "name_saint": NONE if re.search(r"\b(?:St\.?|Saint|San|Santa|Mount|Lake)\s?$", left) or g in ("st", "saint", "san", "santa") else "",
        "name_number": NONE if re.search(r"\d[A-Za-z]?\s?$", left) and initial and next_word in PLACE_WORDS else "",
        "name_shout": NONE if initial and shout and not ending else "",
    }
    return Spot("name", start, end, votes, _context(left, right) + [f"end:{f[-3:]}", f"given:{int(known)}{int(initial)}", f"first:{g}"], None if known or initial else f"{g} {f}")


_TITLE_WORD = re.compile(_TITLE, re.I)
_TITLE_SET = frozenset(re.findall(r"\w+", _TITLE.lower()[3:]))
#: Last words of a title or of a cue that a name is signed.
_LEADS = _TITLE_SET | frozenset("by von por par da unterschrieb firmó name speaker sprecher with mit avec".split())
_TITLED = re.compile(rf"(?:^|\W){_TITLE}\W?$")


def _names(text: str, words: set, given_names: frozenset, common: frozenset) -> list[Spot]:
    out: list[Spot] = []
    in_list = lambda g: g in given_names or ("-" in g and all(x in given_names for x in g.split("-")))

    def propose(pieces: list[tuple[int, int, str]], known: bool) -> None:
        start, end = pieces[0][0], pieces[-1][1]
        left = _left(text, start)
        middle = len(pieces) > 2
        out.append(_name(text, start, end, pieces[0][2], pieces[-1][2], middle, known, common, left, bool(_TITLED.search(left))))

    def run(pieces: list[tuple[int, int, str]]) -> None:
        """Names in a run of words: from each given name of the list, initial or else the run's first words, up to the run's end or the next one."""
        while len(pieces) > 1 and pieces[-1][2].endswith("."):
            pieces = pieces[:-1]
        if len(pieces) < 2:
            return
        lows = [unicodedata.normalize("NFC", p[2]).lower().rstrip(".") for p in pieces]
        # A place or firm by its last word is none, unless a title or a given name of the list opens the run.
        place = lows[-1] in PLACE_WORDS
        starts = [i for i in range(len(pieces) - 1) if in_list(lows[i]) and not pieces[i][2].endswith(".") or (pieces[i][2].endswith(".") and (i == 0 or not in_list(lows[i - 1]) and not pieces[i - 1][2].endswith(".")))]
        for n, i in enumerate(starts):
            to = next((j for j in starts[n + 1 : n + 3] if j > i + 1), len(pieces))
            # Up to the first family name; a middle name, initial or particle in between belongs to it.
            last = i + 1
            while last < to - 1 and (pieces[last][2].endswith(".") or lows[last] in _PARTICLES or in_list(lows[last])):
                last += 1
            if lows[last] in _PARTICLES:
                continue
            # Further capitalised words of the same line, unless the corpus has them in small letters.
            more = pieces[last + 1 : min(to, i + 4)]
            if more and all(p[2][0].isupper() and not p[2].isupper() for p in more) and "\n" not in text[pieces[last][1] : more[-1][1]] and not any(x in COMMON or x in PLACE_WORDS or x in common for x in lows[last : last + 1 + len(more)]):
                last += len(more)
            propose(pieces[i : last + 1], in_list(lows[i]))
        if starts or place:
            return
        mixed = [p for p in pieces if p[2][0].isupper() and not p[2].isupper()]
        left = _left(text, pieces[0][0])
        titled = bool(_TITLED.search(left))
        if len(mixed) == len(pieces) or titled or _SIGN_CUE.search(left):
            # Words that are no part of a name end the candidate on either side.
            a, b = 0, len(pieces)
            while a < b and lows[a] in COMMON:
                a += 1
            while b > a and lows[b - 1] in COMMON:
                b -= 1
            if 2 <= b - a <= 4 and not any(x in COMMON and x not in _PARTICLES for x in lows[a:b]) and not any(x in PLACE_WORDS for x in lows[a:b]):
                propose(pieces[a:b], False)
                if b - a == 3 and not titled and lows[a] in common:
                    propose(pieces[a + 1 : b], False)

    for m in RUN.finditer(text):
        # Most runs are places or signs, which the words alone tell: no given name of the list, initial or title in them.
        parts = _PLAIN_WORDS.findall(m[0].lower())
        if "." not in m[0] and given_names.isdisjoint(parts) and _TITLE_SET.isdisjoint(parts):
            if parts[-1] in PLACE_WORDS:
                continue
            if m[0].isupper() or not COMMON.isdisjoint(parts):
                before = text[max(0, m.start() - 24) : m.start()].split()
                led = before and before[-1].lower().strip(".,:;()-–") in _LEADS
                left = _left(text, m.start()) if led else ""
                if not (led and (_TITLED.search(left) or _SIGN_CUE.search(left))) and (m[0].isupper() or len(COMMON.union(parts)) - len(COMMON) < 2):
                    continue
        pieces = [(m.start() + p.start(), m.start() + p.end(), p[0]) for p in _PIECE.finditer(m[0])]
        if pieces[0][2] == "M." and len(pieces) > 2 and in_list(pieces[1][2].lower()):
            pieces = pieces[1:]  # a title
        # Titles belong to no name and split the run.
        part: list[tuple[int, int, str]] = []
        for p in pieces:
            if len(p[2].rstrip(".")) > 1 and _TITLE_WORD.fullmatch(p[2]) and p[2].lower() not in ("don", "pan"):
                run(part)
                part = []
            else:
                part.append(p)
        run(part)
    # Given names of the list in small letters, where the family name may be small as well.
    known = words & given_names
    if known and (known := known & set(_LOWER_WORDS.findall(text))):
        for m in re.finditer(rf"(?<![\w@.+-])((?:{'|'.join(sorted(known))})(?:-{_LETTER}+)?)((?:{_N}[{_UP}{_LO}]\.)*){_N}({_PART}?)({_FAMILY})(?![\w@+])", text):
            f = m[4].lower()
            if len(f) >= 3 and f not in COMMON:
                left = _left(text, m.start())
                out.append(_name(text, m.start(), m.end(), m[1], m[4], bool(m[2].strip() or m[3].strip()), True, common, left, bool(_TITLED.search(left))))
    if "," in text:
        for m in NAME_BACK.finditer(text):
            listed = in_list(unicodedata.normalize("NFC", m[2]).lower())
            family = unicodedata.normalize("NFC", m[1]).lower()
            start = m.start()
            if part := _PART_LEFT.search(text[max(0, start - 14) : start]):
                start -= len(part[0])
            left = _left(text, start)
            if (listed or m[2].endswith(".") or _SIGN_CUE.search(left)) and family not in COMMON and not in_list(family):
                out.append(_name(text, start, m.end(), m[2], m[1], bool(m[3].strip() or part), listed, common, left, bool(_TITLED.search(left))))
    return out


def _windows(text: str, marks: Iterable[tuple[int, int]], before: int, after: int) -> list[tuple[int, int]]:
    """Joined stretches of the text around the marks, cut at blanks so that no word is halved."""
    out: list[tuple[int, int]] = []
    for start, end in marks:
        a, b = max(0, start - before), min(len(text), end + after)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BREAKS = str.maketrans(dict.fromkeys(",.:;!?()[]\"'’“”-–—/«»<>*_#", " "))


def _word_list(text: str) -> list[str]:
    """Words in small letters, without the marks that stand at them."""
    low = text.lower()
    if low.isascii():
        return low.translate(_BREAKS).split()
    return _PLAIN_WORDS.findall(low)


def spots_of(text: str, common: frozenset = frozenset(), given_names: frozenset = GIVEN) -> list[Spot]:
    """All candidates of a text, of every family; they may overlap. common: words that the corpus writes in small letters often."""
    out: list[Spot] = []
    for a, b in _windows(text, _at_marks(text), 90, 130):
        out += [_email(text, m, common) for m in EMAIL.finditer(text, a, b)]
    for a, b in _windows(text, (m.span() for m in _DIGITS.finditer(text)), 16, 24):
        out += [_phone(text, m) for m in PHONE.finditer(text, a, b)]
        out += [_ident(text, m) for m in IDENT.finditer(text, a, b)]
    words = _word_list(text)
    distinct = set(words)
    # Seven words in a row, with whatever stands between them.
    if not _DIGIT_SET.isdisjoint(distinct) and b"\1\1\1\1\1\1\1" in bytes(map(_DIGIT_SET.__contains__, words)):
        out += [_spelt(text, m) for m in SPELT.finditer(text)]

    def street(m: re.Match) -> bool:
        right = _PLAIN_WORDS.findall(text[m.end() : m.end() + 70].lower())[:6]
        if not _RIGHT_TYPES.isdisjoint(right):
            return True
        left = _PLAIN_WORDS.findall(text[max(0, m.start() - 60) : m.start()].lower())[-6:]
        return not _LEFT_TYPES.isdisjoint(left) or any(w.endswith(_LEFT_ENDINGS) for w in left[-3:])

    for a, b in _windows(text, (m.span() for m in _HOUSE.finditer(text) if street(m)), 80, 80):
        out += [_address(text, m) for m in ADDRESS.finditer(text, a, b)]
    out += _names(text, distinct, given_names, common)
    for s in out:
        s.start = _first(text, s.start, s.end)
    return out
