"""Problem 9: personal information inside free text, found and replaced by typed placeholders.

Regular expressions propose spans with a score for their shape; a checksum (Luhn, mod 97, mod 23, mod 11) that holds raises it, one
that fails lowers it; a label, context words before the span and words that deny it (order, version, ...) move it on; a span counts
from ``ACCEPT`` on. So a number without a label counts by its checksum, one with a label counts even with a typing error, and a
payment card or account number never counts with a wrong checksum. Names need parts that are known: the given list is completed
with the parts that stand in unmistakable contexts ("My name is ...") anywhere in the collection.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.words import slices
from termforge.plans.tables import cut

ACCEPT = 1.0
#: A name part found in contexts counts as known from this many places on.
LEAST_PLACES = 2
#: Up to this many parts of each kind are sent to the tasks; more are joined to the words of the texts by shuffle.
MOST_PARTS = 200_000
#: Context words are looked for in this many characters before and after a span.
NEAR = 40

_AT = r"(?:@|\s@\s|\s?\[at\]\s?|\s?\(at\)\s?|\s?\{at\}\s?|\s+AT\s+)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\{dot\}\s?|\s+DOT\s+|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+@-])(?P<local>[\w][\w.+'%-]*){_AT}(?P<domain>[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,12}})(?![\w@-])")
EMAIL_IN_WORDS = re.compile(r"(?<![\w.+@-])(?P<local>[\w][\w.+'%-]*)\s+at\s+(?P<domain>[\w-]+(?:\s+dot\s+[\w-]+)*\s+dot\s+[A-Za-z]{2,12})(?![\w@-])")
PHONE = re.compile(
    r"""(?<![\w/+.,-])(?<!\d\s)(?:
    (?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5} |
    \(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5} |
    0\d{2,5}[ ./-]\d{5,9} | 0\d{1,4}(?:[ .-]\d{2,4}){2,4} |
    [2-9]\d{2}([.-])\d{3}\1\d{4} | [2-9]\d{2}\ \d{3}[ -]\d{4} | 1[2-9]\d{9}
    )(?![\w-]|[.,/]\d)""",
    re.X,
)
#: kind of number -> (label before it, the number itself, checksum or None)
_LABEL_GAP = r"(?:\s*(?:no\.?|number|num\.?|nr\.?|nº|n°|id)\b\.?)?\s*(?:is|was|:|\#|=)?\s*"
_SOCIAL = r"(?:SSN|social\s+(?:security|insurance)|sécurité\s+sociale|seguridad\s+social|Sozialversicherungs\w*|Versicherten\w*)"
_NATIONAL = r"(?:personal|national|identity|identification|person|civil)\s+(?:id(?:entity)?|identification|registration|number)|personal(?:nummer|ausweis)|personnummer|PESEL|CPF|NIR"
_PASSPORT = r"(?:passport|Reisepass|Pass(?:nummer|-Nr\.?)|passeport|pasaporte|passaporte|paszport\w*)"
_TAX = r"(?:tax(?:payer)?(?:\s+(?:id(?:entification)?|number|reference))?|TIN|ITIN|EIN|Steuer(?:nummer|-?ID|identifikationsnummer)|numéro\s+fiscal|NIF|NIP|VAT)"
_CARD = r"(?:identity\s+card|ID\s+card|DNI|NIE|carte\s+d['’]identité|cédula|Ausweis\w*|dowód\s+osobisty)"
_INSURANCE = r"(?:NI|NINO|national\s+insurance|insurance)"


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits)))
    return len(digits) > 1 and total % 10 == 0


def mod97(number: str) -> bool:
    """The check of international account numbers: letters as numbers, the first four characters at the end."""
    s = re.sub(r"\W", "", number).upper()
    if len(s) < 5 or not s.isalnum() or not s.isascii():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod23(number: str) -> bool:
    """The letter of an eight-digit identity card, or of a resident's one, whose first letter stands for a digit."""
    s = re.sub(r"\W", "", number).upper()
    s = str("XYZ".index(s[0])) + s[1:] if s[:1] in ("X", "Y", "Z") else s
    return len(s) == 9 and s[:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]


def mod11(number: str) -> bool:
    """The two last digits of an eleven-digit taxpayer number."""
    d = [int(c) for c in number if c.isdigit()]
    return len(d) == 11 and len(set(d)) > 1 and all(sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10 == d[n] for n in (9, 10))


def _dated(number: str) -> bool:
    """Six first digits that are a date: year, month, day (or day with 60 added)."""
    d = re.sub(r"\D", "", number)[-10:]
    return 1 <= int(d[2:4]) <= 12 and (1 <= int(d[4:6]) <= 31 or 61 <= int(d[4:6]) <= 91)


@dataclass(frozen=True)
class Kind:
    """A form of number: its labels, its pattern, the score of the shape, its checksum, what a checksum that fails takes off."""

    kind: str
    labels: str
    number: str
    shape: float
    check: Callable[[str], bool] | None = None
    wrong: float = 0.3


LABEL, VALID, CONTEXT_WORDS, DENIED = 0.95, 0.5, 0.4, 0.6
_CREDIT = r"(?:(?:credit|debit|payment|bank)\s+card|Kreditkarte|carte\s+bancaire|tarjeta|cartão|Visa|Mastercard|Amex)"
_ACCOUNT = r"(?:IBAN|account|Konto(?:nummer)?|compte|cuenta|conta)"
#: The forms of numbers. Luhn is one of several checks of long plain numbers, so that its failing says nothing there.
_NUMBERS = [
    Kind("payment_card", _CREDIT, r"[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}", 0.5, luhn, 1.5),
    Kind("bank_account", _ACCOUNT, r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?", 0.5, mod97, 1.5),
    Kind("id_number", _SOCIAL, r"\d{3}[- ]\d{2}[- ]\d{4}", 0.5),
    Kind("id_number", _SOCIAL + "|" + _NATIONAL, r"\d{9,13}", 0.1, luhn, 0.0),
    Kind("id_number", _NATIONAL, r"(?:19|20)?\d{6}[-+ ]\d{4}", 0.5, lambda x: luhn(re.sub(r"\D", "", x)[-10:]) and _dated(x)),
    Kind("id_number", _NATIONAL + "|CPF", r"\d{3}\.\d{3}\.\d{3}-\d{2}", 0.5, mod11),
    Kind("id_number", _PASSPORT, r"[A-Z]{1,2}[ ]?\d{6,9}|\d{9}|[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8}", 0.1),
    Kind("id_number", _TAX, r"\d{2}-\d{7}|\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}|\d{3}[-/]\d{3,4}[-/]\d{4,5}|\d{10,11}|9\d{2}-\d{2}-\d{4}|[A-Z]\d{8}", 0.2),
    Kind("id_number", _CARD, r"\d{8}[- ]?[A-Za-z]|[XYZ][- ]?\d{7}[- ]?[A-Z]", 0.5, mod23),
    Kind("id_number", _CARD, r"[A-Z]{1,3}[ ]?\d{6,9}|\d{9,11}", 0.1),
    Kind("id_number", _INSURANCE, r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|QQ[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]", 0.5),
]
_LABELLED = [re.compile(rf"(?<![\w-])(?:{k.labels}){_LABEL_GAP}(?P<n>{k.number})(?![\w])", re.I) for k in _NUMBERS]
_BARE = [re.compile(rf"(?<![\w.,/-])(?P<n>{k.number})(?![\w-]|[.,]\d)") for k in _NUMBERS]
_CONTEXT = [re.compile(rf"(?<![\w-])(?:{k.labels})(?!\w)", re.I) for k in _NUMBERS]


def number_score(form: Kind, number: str, labelled: bool, before: str, context: re.Pattern) -> float:
    """The score of a proposed number after the text ``before``."""
    score = form.shape + LABEL * labelled - DENIED * bool(_NO_PHONE_NEAR.search(before))
    if form.check:
        score += VALID if form.check(number) else -form.wrong
    return score + (CONTEXT_WORDS if not labelled and context.search(before) else 0.0)


_DIGITS3 = re.compile(r"\d")
_LONG_NUMBER = re.compile(r"\d[\d ().+/-]{4,}\d")
#: Any of the labels themselves.
_LABEL_SIGN = re.compile(rf"(?<![\w-])(?:{'|'.join(dict.fromkeys(k.labels for k in _NUMBERS))})", re.I)
_AT_SIGN = re.compile(r"@|[Aa][Tt][\])}]|\sAT\s|\sdot\s")

_UP = r"[A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻŠŽČ]"
_WORD = rf"{_UP}[\w'’-]+"
_UNIT = r"(?:(?:Apt|Apartment|Suite|Ste|Unit|Flat|App|Appt|Room)\b\.?\s*[#]?\s*\w{1,5},?\s+)?"
#: Words that end or begin street names.
_STREETS = r"(?:Street|St|Avenue|Ave|Av|Road|Rd|Lane|Ln|Boulevard|Blvd|Close|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Crescent|Cres|Row|Hill|Gardens|Parkway|Pkwy|Highway|Hwy|Walk|Mews|Circle|Grove|Park)"
#: The same in other languages.
_RUES = r"[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]oulevard|[Bb]d\.?|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare"
_STRASSEN = r"straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|markt|steig|hof|Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer|Markt|Tor"
_AN_DER = r"Am|An\s+der|Im|In\s+der|Zum|Zur|Auf\s+dem|Unter\s+den"
_CALLES = r"C/|Calle|C\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Ronda|Rua|Praça|Travessa|Via|Viale|Corso|Piazza"
_ULICE, _ULITSY = r"ul\.|al\.|pl\.|os\.|aleja|ulica", r"ул\.|улица|пр\.|проспект|пер\."
ADDRESS = re.compile(
    rf"""(?<![\w/-])(?:
    {_UNIT}\d{{1,5}}\ ?[A-Za-z]?(?:\s*-\s*\d+)?,?\s+(?:[NSEW]{{1,2}}\.?\s+|(?:North|South|East|West)\s+)?(?:{_WORD}\.?\s+){{1,3}}{_STREETS}\b\.? |
    {_UNIT}\d{{1,4}}(?:\s?(?:bis|ter|[A-Da-d])\b)?,?\s+(?:{_RUES})\s+(?:de\s+la\s+|de\s+l['’]\s*|des\s+|du\s+|de\s+|d['’]\s*)?{_UP}[\w'’-]+ |
    (?:(?:{_UP}[a-zäöüß-]*|[A-ZÄÖÜ][a-zäöüß-]+\s)(?:{_STRASSEN})|(?:{_AN_DER})\s+(?:[A-Za-zäöü]+(?:en|er|em)\s+)?(?!Jahr|Januar|Februar|März|April|Mai|Juni|Juli|August|Septem|Oktober|Novem|Dezem|Alter|Schnitt|Kapitel|Band|Absatz){_UP}[a-zäöüß]+)\s+\d{{1,4}}\ ?[a-z]?\b(?:\s*[-/]\s*\d+)? |
    (?:{_CALLES})\s*(?:(?:de\s+los|de\s+las|de\s+la|del|de|da|do|das|dos)\s+)?(?:{_UP}[\w'’-]+\s?){{1,4}},?\s*(?:n[.º°]+\s*)?\d{{1,4}}\ ?[a-zA-Z]?\b |
    (?:{_ULICE})\s+(?:{_UP}[\w-]+\s+){{1,3}}\d{{1,4}}\ ?[a-zA-Z]?\b(?:\s*/\s*\d+)? |
    (?:{_ULITSY})\s+(?:[А-ЯЁ][\w-]+\s*){{1,3}},?\s*(?:д\.\s*)?\d{{1,4}}
    )""",
    re.X,
)
#: What every address of a kind holds, built of the same words as ``ADDRESS``.
_ADDRESS_SIGN = re.compile(rf"{_STREETS}\b|(?:{_RUES})\s|(?:{_STRASSEN})\s+\d|(?<![\w/-])(?:(?:{_AN_DER})\s|(?:{_CALLES}|{_ULICE}|{_ULITSY}))")

#: Titles before names.
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam|Madame|Monsieur|Mme|Mlle|M\.|Herr|Frau|Señora?|Sra?|Don|Doña|Dra|Pan|Pani|Rev|Hon)"
_TITLE_RUN = rf"(?:{_TITLES}\b\.?\s+)*"
_PART = r"[^\W\d_](?:[\w]|['’-](?=\w))+"
_INITIAL = r"[^\W\d_]\."
_NAME = rf"(?:{_PART},\s(?:{_INITIAL}|{_PART})(?:\s{_INITIAL}|\s{_PART})?|(?:{_INITIAL}|{_PART})(?:\s(?:{_INITIAL}|{_PART}))?\s{_PART})"
#: What stands right before or after a name and hardly ever before or after anything else.
_BEFORE = r"(?:\b[Mm]y name is|\b[Ss]igned by|\bwitnessed by|\b[Aa]ccording to|\b[Aa]sk for|\b[Aa]ccount of|\b[Bb]ill to:?|\b[Cc]ontact:|\bKontakt:|\b[Aa]pplicant:|\"(?:user|name|author|contact)\"\s*:\s*\"|\bMadame|\bMonsieur|\b[Pp]atient:|\b[Nn]ame:|\b[Ii]ch heiße|\b[Mm]e llamo|\b[Jj]e m['’]appelle|\b[Mm]ein Name ist|\b[Ff]rom:|\b[Aa]ttn:?|\bcare of|\bc/o)\s?"
_AFTER = r"(?=\s(?:habite\b|lives at|wohnt\b|vive en\b|mieszka\b))"
_STOP = r"(?=[,;.:(\"\n]|\s(?:and|with|at|for|from|wrote|checked|habite|lives|und|et|y|is|has|was|und|mit|con|by|in|on)\b|\s[<(\[]|\s?$)"
CONTEXT = re.compile(rf"{_BEFORE}{_TITLE_RUN}(?P<a>{_NAME}?){_STOP}", re.M)
CONTEXT_AFTER = re.compile(rf"(?<![\w@.])(?:\band\s)?{_TITLE_RUN}(?P<b>{_NAME}){_AFTER}", re.M)
_SIGN_OFF = re.compile(rf"^(?:(?:Best wishes|Best|Kind regards|Regards|Thanks|Thank you|Cheers|Sincerely|Yours|Viele Grüße|Mit freundlichen Grüßen|Cordialement|Saludos|Atentamente),?|.*\b(?:Regards|wishes|Thanks),?)\s+{_TITLE_RUN}(?P<c>{_NAME})\s*$", re.M)
_TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\b\.?\s+(?P<d>{_NAME})")
#: What texts hold in which the patterns above can match, lower-cased but for titles.
_BEFORE_STEMS = ("name is", "name:", "signed by", "witnessed by", "according to", "ask for", "account of", "bill to", "contact:", "kontakt:", "applicant:", '"user"', '"name"', '"author"', '"contact"', "madame", "monsieur", "patient:", "heiße", "me llamo", "appelle", "from:", "attn", "care of", "c/o")
_AFTER_STEMS = ("habite", "lives at", "wohnt", "vive en", "mieszka")
_SIGN_STEMS = ("wishes", "regards", "thank", "cheers", "sincerely", "yours", "grüße", "grüßen", "cordialement", "saludos", "atentamente")
_BEST = re.compile(r"^Best,?\s", re.M)
_TITLE_STEMS = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme")
_TOKENS = re.compile(rf"{_INITIAL}(?!\w)|{_PART}")
#: Capitalised words that are no parts of names.
_NO_PART = frozenset("the a an this that these those it he she they we i you my your our his her their its museum institute press archive library council trust street road lane avenue inc ltd gmbh company university department regards thanks wishes best hello hi dear all contact kontakt tel phone fax question answer if when some many most do what who why how and or of in at on by for from to with no one only news ask call".split())


@dataclass
class Names:
    """Known parts, lower-cased; where they are too many for the tasks, they stand in ``table`` (part, kind) and the sets are empty."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    pattern: re.Pattern | None = field(default=None, compare=False)
    table: DataFrame | None = field(default=None, compare=False)


def _shape(part: str) -> str:
    if _INITIAL_RE.fullmatch(part):
        return "initial"
    return "upper" if part.isupper() else "lower" if part.islower() else "title" if part[0].isupper() else "other"


_INITIAL_RE = re.compile(_INITIAL)


def _parts(span: str) -> tuple[list[str], list[str]] | None:
    """(given parts, family parts) of a span of the form of a name, None if the words cannot be a name."""
    tokens = _TOKENS.findall(span)
    if not 2 <= len(tokens) <= 3 or any(t.lower() in _NO_PART for t in tokens):
        return None
    shapes = {_shape(t) for t in tokens} - {"initial"}
    if len(shapes) != 1 or "other" in shapes:
        return None
    return (tokens[1:], tokens[:1]) if "," in span else (tokens[:-1], tokens[-1:])


def context_names(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, strong) of spans that stand where a name must stand."""
    out: list[tuple[int, int, bool]] = []
    lowered = text.lower()
    for pattern, group, stems in ((CONTEXT, "a", _BEFORE_STEMS), (CONTEXT_AFTER, "b", _AFTER_STEMS), (_SIGN_OFF, "c", _SIGN_STEMS)):
        if any(x in lowered for x in stems) or group == "c" and _BEST.search(text):
            out += [(*m.span(group), True) for m in pattern.finditer(text)]
    if any(x in text for x in _TITLE_STEMS):
        out += [(*m.span("d"), False) for m in _TITLED.finditer(text)]
    return out


def harvested(text: str) -> list[tuple[str, str]]:
    """(part, kind) of the names in unmistakable contexts."""
    out = []
    for start, end, strong in context_names(text):
        span = text[start:end]
        found = _parts(span)
        if not found or not strong or any(_shape(t) == "lower" for t in found[0] + found[1]):
            continue
        out += [(t.lower(), "given") for t in found[0] if _shape(t) != "initial"] + [(t.lower(), "family") for t in found[1] if _shape(t) != "initial"]
    return out


_LOWER_PARTS = re.compile(_PART)
_INITIAL_OR_PART = re.compile(rf"(?<![\w@.'’-])(?:{_INITIAL}|{_PART})(?![\w@])")


def names_in(text: str, names: Names, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of names: known parts beside each other, and unknown ones where a name must stand."""
    known_g, known_f = names.given, names.family
    found: list[tuple[int, int]] = []
    # every pair of known parts holds a family name; most texts hold none
    tokens = [] if known_f.isdisjoint(_LOWER_PARTS.findall(text.lower())) else [(m.start(), m.end(), m.group()) for m in _INITIAL_OR_PART.finditer(text)]
    low = [t[2].lower() for t in tokens]
    shapes = [_shape(t[2]) for t in tokens]
    i, n = 0, len(tokens)

    def gap(a: int, b: int) -> str:
        return text[tokens[a][1] : tokens[b][0]]

    def alike(*at: int) -> bool:
        kinds = {shapes[k] for k in at} - {"initial"}
        return len(kinds) == 1 and "other" not in kinds

    while i < n:
        end = -1
        first_given = low[i] in known_g or shapes[i] == "initial" and shapes[i] is not None and tokens[i][2][0].isupper()
        if first_given:
            # given [given or initial] family
            if i + 2 < n and gap(i, i + 1) == " " and gap(i + 1, i + 2) == " " and low[i + 2] in known_f and (low[i + 1] in known_g or shapes[i + 1] == "initial") and alike(i, i + 1, i + 2) and low[i] in known_g:
                end = i + 2
            elif i + 1 < n and gap(i, i + 1) == " " and low[i + 1] in known_f and alike(i, i + 1):
                end = i + 1
        if end < 0 and low[i] in known_f and i + 1 < n and gap(i, i + 1) == ", " and (low[i + 1] in known_g or shapes[i + 1] == "initial") and alike(i, i + 1):
            end = i + 1
            if i + 2 < n and gap(i + 1, i + 2) == " " and (shapes[i + 2] == "initial" or low[i + 2] in known_g and low[i + 2] not in known_f) and alike(i, i + 1, i + 2):
                end = i + 2
        if end >= 0:
            found.append((tokens[i][0], tokens[end][1]))
            i = end + 1
        else:
            i += 1
    for start, end, strong in context_names(text):
        span = text[start:end]
        parts = _parts(span)
        if not parts or any(s < end and start < e for s, e in found):
            continue
        every = [t.lower() for t in parts[0] + parts[1] if _shape(t) != "initial"]
        hits = sum(t in known_g or t in known_f for t in every)
        lower = any(_shape(t) == "lower" for t in parts[0] + parts[1])
        if hits and (strong or not lower) or strong and not lower:
            found.append((start, end))
    return [x for x in sorted(found) if not any(s < x[1] and x[0] < e for s, e in taken)]


_PHONE_NEAR = re.compile(r"\b(?:tel|telephone|phone|fax|mobile|cell|call|ring|dial|anrufe|telefon|llama|appel\w*|whatsapp|number|reach)\b|phone=", re.I)
_NO_PHONE_NEAR = re.compile(r"\b(?:order|batch|isbn|seed|build|ratio|sum|version|invoice|page|pages|rank|score\w*|hits|id)\s*[:#=]?\s*$", re.I)


def spans(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal information in a text, by place and without overlaps; offsets count characters from 0."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if not any(s < end and start < e for s, e in taken):
            taken.append((start, end))
            out.append((kind, start, end))

    if _AT_SIGN.search(text):
        for pattern in (EMAIL, EMAIL_IN_WORDS):
            for m in pattern.finditer(text):
                local = m.group("local")
                add("email", m.start(), m.end()) if local.lower() != "mailto" else None
    if _DIGITS3.search(text):
        labels = bool(_LABEL_SIGN.search(text))
        long_number = bool(_LONG_NUMBER.search(text))
        for patterns in ((_LABELLED,) if labels else ()) + ((_BARE,) if long_number else ()):
            for pattern, form, context in zip(patterns, _NUMBERS, _CONTEXT):
                if patterns is _BARE and not form.check and not labels:
                    continue  # neither a checksum nor a context word can bring such a shape to the score
                for m in pattern.finditer(text):
                    labelled = patterns is _LABELLED
                    at = m.start() if labelled else m.start("n")
                    if number_score(form, m.group("n"), labelled, text[max(0, at - NEAR) : at], context) >= ACCEPT:
                        add(form.kind, *m.span("n"))
        if long_number:
            for m in PHONE.finditer(text):
                digits = sum(c.isdigit() for c in m.group())
                if not 7 <= digits <= 15:
                    continue
                before = text[max(0, m.start() - NEAR) : m.start()]
                score = 0.6 + 0.4 * (m.group()[0] in "+(" or m.group().startswith("00")) + 0.5 * bool(_PHONE_NEAR.search(before)) + 0.4 * bool(re.search(r"[.\-/ ]", m.group())) - bool(_NO_PHONE_NEAR.search(before))
                if score >= ACCEPT:
                    add("phone", m.start(), m.end())
        if _ADDRESS_SIGN.search(text):
            for m in ADDRESS.finditer(text):
                add("address", m.start(), m.end())
    for start, end in names_in(text, names, taken):
        add("name", start, end)
    return sorted(out, key=lambda x: x[1])


def masked(text: str | None, names: Names) -> str | None:
    """The text with ``[KIND]`` in place of every span; null stays null."""
    if text is None:
        return None
    at, out = 0, []
    for kind, start, end in spans(text, names):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _harvest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches, 0):
        found = Counter(x for t in texts if t for x in harvested(t))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["part", "kind", "n"])


def known_names(df: DataFrame, text: str, parts: DataFrame, part: str, kind: str) -> Names:
    """The listed name parts and those that stand in contexts of at least ``LEAST_PLACES`` places of the collection.

    Counts are combined before the shuffle; the driver gets the parts only if there are at most ``MOST_PARTS`` of each kind.
    """
    counts = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(_harvest_batches, "part string, kind string, n bigint")
    counts = counts.groupBy("part", "kind").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PLACES).select("part", "kind")
    listed = parts.where(F.col(part).isNotNull()).select(F.lower(F.trim(part)).alias("part"), F.lower(kind).alias("kind")).where("kind in ('given', 'family')")
    known = cut(counts.union(listed).where("part <> ''").distinct(), "name-parts")
    if any(r["count"] > MOST_PARTS for r in known.groupBy("kind").count().collect()):
        return Names(table=known)
    out: dict[str, set[str]] = {"given": set(), "family": set()}
    for r in known.toLocalIterator():
        out[r["kind"]].add(r["part"])
    return Names(frozenset(out["given"]), frozenset(out["family"]))


def _words_of(text: str) -> set[str]:
    """Every word of a text that ``names_in`` looks up."""
    found = {t.lower() for t in _INITIAL_OR_PART.findall(text)} | set(_LOWER_PARTS.findall(text.lower()))
    return found.union(*({t.lower() for t in _TOKENS.findall(text[start:end])} for start, end, _ in context_names(text)))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1):
        found = [sorted(_words_of(t)) for t in texts]
        rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([w for x in found for w in x], pa.string())], names=["id", "part"])


def _with_parts(source: DataFrame, table: DataFrame) -> DataFrame:
    """``record, text, given, family``: every row with the known parts among its words, joined by shuffle; no part is left out."""
    rows = cut(source.withColumn("id", F.monotonically_increasing_id()), "texts")
    words = rows.select("id", "text").where("text is not null").mapInArrow(_word_batches, "id bigint, part string")
    sets = [F.collect_set(F.when(F.col("kind") == k, F.col("part"))).alias(k) for k in ("given", "family")]
    found = words.join(table, "part").groupBy("id").agg(*sets)
    return rows.join(found, "id", "left").select("record", "text", "given", "family")


def _each(batch: pa.RecordBatch, texts: list[str | None], names: Names) -> Iterator[tuple[str | None, Names]]:
    """Each text with the names that count for it."""
    if batch.num_columns < 4:
        return ((t, names) for t in texts)
    return ((t, Names(frozenset(g or ()), frozenset(f or ()))) for t, g, f in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()))


def _span_batches(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            rows, kinds, starts = [], [], []
            for i, (text, known) in enumerate(_each(batch, texts, names)):
                for kind, start, _ in spans(text, known):
                    rows.append(i)
                    kinds.append(kind)
                    starts.append(start + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64())], names=["record", "kind", "start_pos"])

    return run


def _mask_batches(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([masked(*x) for x in _each(batch, texts, names)], pa.string())], names=["record", "masked"])

    return run


def personal_spans(df: DataFrame, record: str, text: str, names: Names) -> DataFrame:
    """``record, kind, start_pos``: a row per place, characters counted from 1, once per record. Null, empty and blank texts give none."""
    source = df.select(F.col(record).alias("record"), F.col(text).alias("text")).where("text is not null")
    if names.table is not None:
        source, names = _with_parts(source, names.table), Names()
    return source.mapInArrow(_span_batches(names), f"record {source.schema['record'].dataType.simpleString()}, kind string, start_pos bigint").distinct()


def masked_texts(df: DataFrame, record: str, text: str, names: Names) -> DataFrame:
    """``record, masked``: one row per row of ``df`` with typed placeholders; null stays null, text without cases stays as it is."""
    source = df.select(F.col(record).alias("record"), F.col(text).alias("text"))
    if names.table is not None:
        source, names = _with_parts(source, names.table), Names()
    return source.mapInArrow(_mask_batches(names), f"record {source.schema['record'].dataType.simpleString()}, masked string")
