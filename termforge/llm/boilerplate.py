"""Problem 3: the article of a page without the furniture around it.

Every page goes the same way. The standard library's streaming HTML parser gives each line its characters of text, of links,
and its tags; a page without tags is one data event. What plain text has instead of tags is evidence of links, counted in
the same unit:

* parts of lines (between separators, or sentences) that stand on many pages of the collection, copies of a page counted once;
* rows and lists of short entries, as after a line that introduces lists of titles on many pages;
* words that say what a line is (cookie notices, menus, paths, sharing, paging, footers), as far as a list has them.

The text-to-tag ratio of each line, on a logarithmic scale, is smoothed with a Gaussian; two clusters of the smoothed values
give a threshold, and the lines at or below it are furniture, whatever their words. So a short line that recurs ("Events") goes
with the menu that it stands in, or stays as a subhead amid paragraphs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate
from math import ceil, exp, log1p
from operator import mul

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.encodings import is_garbled, restore
from termforge.llm.words import slices, words
from termforge.plans.tables import cut, join_sized

#: A part of a line recurs if it stands on this share of all pages or on this share of one site's pages, and on so many pages at least
#: (pages that share their longest line count once).
PAGE_SHARE, SITE_SHARE, LEAST_PAGES = 0.003, 0.1, 8
#: The share of a recurring part's pages on which a list of titles follows, from which on it introduces one.
HEAD_SHARE = 0.6
#: Up to this many recurring parts go to the tasks (about 100 bytes each in a worker); more are joined to the pages by shuffle.
MOST_PARTS = 200_000
#: The threshold between the clusters lies between these smoothed values, so that pages all of one kind are not cut in two.
LEAST_CUT, MOST_CUT = 2.15, 2.4
#: Width of the Gaussian, in lines.
SIGMA = 0.6
#: Characters that a line without any tag counts for at least: short lines of plain text are no links by being short.
PLAIN_CHARS = 80

#: Entries of menus and footers in the corpus's languages, lower-cased.
MENU = frozenset(
    """home|news|shop|products|about|about us|contact|contact us|help|faq|log in|login|sign in|sign up|register|subscribe|search|sitemap|archive|archives|careers|jobs|
events|gallery|topics|forum|my account|account|blog|press|team|services|support|store|cart|menu|terms|terms of use|terms of service|privacy|privacy policy|cookies|cookie policy|imprint|legal notice|accessibility|
accueil|produits|boutique|à propos|actualités|aide|connexion|rechercher|recherche|s'inscrire|contactez-nous|panier|mentions légales|confidentialité|plan du site|
startseite|produkte|über uns|kontakt|hilfe|suche|anmelden|registrieren|archiv|aktuelles|impressum|datenschutz|agb|warenkorb|presse|karriere|
inicio|productos|tienda|noticias|ayuda|buscar|iniciar sesión|contacto|quiénes somos|registrarse|aviso legal|privacidad|carrito|mapa del sitio|
início|produtos|loja|notícias|ajuda|pesquisar|entrar|contato|contacto|sobre nós|política de privacidade|termos|
strona główna|produkty|sklep|aktualności|pomoc|szukaj|zaloguj się|kontakt|o nas|regulamin|polityka prywatności|
главная|новости|магазин|контакты|помощь|поиск|войти|о нас|регистрация|конфиденциальность|
ホーム|ニュース|お問い合わせ|会社概要|ログイン|検索|ヘルプ|製品|サイトマップ|プライバシー|利用規約""".replace("\n", "").split("|")
)
#: Heads of lists of teasers.
_TEASERS = re.compile(
    r"(?:related (?:articles|posts|stories|topics|content|pages)|popular (?:this week|now|posts|articles|today)|you (?:may|might) (?:also )?(?:like|enjoy)|most (?:read|popular|viewed|shared)|trending (?:on|now|today)\b.*|trending|more (?:from|on|in|stories|articles|news)\b.*|"
    r"read (?:next|also|more)|see also|recommended(?: for you| reading)?|latest (?:news|posts|articles|stories)|editor.?s picks?|don.?t miss|up next|what to read next|"
    r"à lire aussi|articles (?:liés|similaires|connexes)|les plus lus|à découvrir|sur le même sujet|das könnte (?:sie|dich|ihnen)(?: auch)? (?:interessieren|gefallen)|mehr zum thema|meistgelesen|ähnliche (?:artikel|beiträge)|lesen sie auch|weitere artikel|"
    r"artículos relacionados|también te puede interesar|lo más (?:leído|visto)|más noticias|te recomendamos|artigos relacionados|leia também|mais lidas|veja também|você também pode gostar|zobacz (?:też|także)|czytaj (?:też|także|również)|najczęściej czytane|powiązane artykuły|может быть интересно|читайте также|похожие статьи|самое читаемое|関連記事|おすすめ記事|人気記事)\s*:?",
    re.I,
)
#: What lines of furniture begin with or hold.
_CUES = re.compile(
    r"""(?:
    skip\s+to\s+(?:main\s+)?(?:content|navigation) | (?:menu|menü|menú)\s*[☰≡▾▼+]? | [☰≡]\s*(?:menu|menü|menú)? | you\s+are\s+here\s*: .* | (?:sie\s+sind\s+hier|vous\s+êtes\s+ici|estás\s+aquí|está\s+aquí|você\s+está\s+aqui|jesteś\s+tutaj|вы\s+здесь)\s*: .* |
    (?:home|startseite|accueil|inicio|início)\s*[>»/›→]\s*.* |
    (?:accept|reject|allow|decline|agree\s+to)\s+(?:all|cookies|all\s+cookies)\b.{0,60} | \[?\s*agree\s*\]?(?:\s*\[?\s*decline\s*\]?)? | (?:manage|cookie)\s+(?:preferences|settings|consent) | i\s+(?:agree|accept)\W* |
    (?:alle|alles)\s+akzeptieren\b.{0,50} | ablehnen\b.{0,40} | einstellungen | tout\s+(?:accepter|refuser)\b.{0,50} | refuser\b.{0,40} | paramétrer | aceptar\s+tod[oa]s?\b.{0,50} | rechazar\b.{0,40} | configurar | aceitar\s+tud[oa]s?\b.{0,50} | zaakceptuj\b.{0,40} | принять\s+все.{0,40} |
    .{0,80}\b(?:we|this\s+(?:site|website|page)|our\s+(?:site|website|partners))\s+(?:use|uses|set|sets|store|stores)\b.{0,30}\bcookies\b.* | .{0,60}\band\s+(?:its|our|their)\s+partners\b.{0,80}\b(?:cookies?|data)\b.* | cookies\s+(?:help|are|allow|enable)\b.* | your\s+privacy\s+(?:matters|is)\b.* |
    (?:ce\s+site|nous|notre\s+site)\b.{0,40}\bcookies\b.* | (?:diese\s+(?:seite|website)|wir|unsere\s+(?:seite|website))\b.{0,40}\bcookies\b.* | (?:este\s+sitio|usamos|utilizamos|nuestro\s+sitio|nosotros|este\s+site|nosso\s+site)\b.{0,40}\bcookies\b.* | .{0,60}\bпользу\w+\s+(?:файлы\s+)?cookie.* | .{0,60}\bplik(?:i|ów)\s+cookies?.* | .{0,40}(?:クッキー|Cookie)を使用.* |
    advertisement\b.{0,60} | anzeige | publicité | publicidad | sponsored\b\s*[:–-]?.* | (?:ad|ads|promoted)\s*(?:[:–-].*)? | click\s+here\s+(?:to|for)\b.{0,80} | download\s+our\s+(?:free\s+)?app\b.{0,60} | sign\s+up\s+(?:for|to)\b.* | (?:subscribe|join)\s+(?:to|for|our)\b.{0,40}\b(?:newsletter|letter|list)\b.{0,80} |
    share\s+(?:this|on|via|with)\b.* | (?:teilen|partager|compartir|compartilhar|udostępnij|поделиться)\b\s*:?.{0,80} | tweet\w*\s+\d+.{0,60} | (?:like|tweet|pin\s+it|share|e-?mail|print|whatsapp)(?:\s+\d+)?(?:\s*[|/•·]\s*(?:like|tweet|pin\s+it|share|e-?mail|print)(?:\s+\d+)?)* | follow\s+(?:us|\S+)\s+on\b.{0,80} | \d+\s+(?:shares|likes|comments) |
    (?:tags?|filed\s+under|categories|category|schlagwörter|mots-clés|étiquettes|etiquetas|tagi|теги)\s*:.* |
    (?:[«‹<←]\s*)?(?:prev(?:ious)?|next|older|newer|zurück|weiter|précédent|suivant|anterior|siguiente)(?:\s+(?:page|posts?|article|entries))?(?:\s*[»›>→])?(?:[\s|/•·]+(?:[«‹<←]\s*)?(?:prev(?:ious)?|next|older|newer|zurück|weiter|précédent|suivant|anterior|siguiente)(?:\s+(?:page|posts?|article|entries))?(?:\s*[»›>→])?)* | page\s+\d+\s+(?:of|/)\s+\d+ | [«‹<←]?\s*(?:\d{1,4}\s+){2,}(?:…|\.\.\.)\s*\d{1,4}\s*[>»›→]? | [«‹<←]?\s*1(?:\s+\d{1,3}){2,}\s*[>»›→] | (?:load|show|view)\s+(?:more|all)\b.{0,40} |
    (?:©|\(c\)|copyright\b).* | .{0,80}\b(?:all\s+rights\s+reserved|alle\s+rechte\s+vorbehalten|tous\s+droits\s+réservés|todos\s+los\s+derechos\s+reservados|todos\s+os\s+direitos\s+reservados|wszelkie\s+prawa\s+zastrzeżone|все\s+права\s+защищены)\b.{0,60} | powered\s+by\b.{0,60} | all\s+content\s+on\s+this\s+(?:site|website|page)\b.* | .{0,80}\bnot\s+responsible\s+for\s+the\s+content\b.* | (?:back\s+to\s+top|to\s+the\s+top|nach\s+oben|haut\s+de\s+page|volver\s+arriba)\W* | (?:leave\s+a\s+(?:reply|comment)|post\s+a\s+comment|report\s+(?:this|abuse))\b.{0,40}
    )\s*$""",
    re.I | re.X,
)
_SPLIT = re.compile(r"\s*[|/•·›»>→]\s*|\s{2,}|\t")
_SENTENCE_END = re.compile(r"[.!?…。！？:;]['\"”’»)\]]*\s*$")
_MARKER = re.compile(r"^\s*(?:[-–•*›»·▪]|\d{1,3}[.)]|[a-z]\))\s+")
_INNER_END = re.compile(r"[^\W\d_][.?!]”? [“\"]?[^\W\d_]")
_SHORT_SENTENCE = re.compile(r"[.!?。]['\"”’»)\]]*\s*$")
_ENDS = frozenset(".!?。'\"”’»)]")
#: What a line is by itself.
PLAIN, FURNITURE, UNDECIDED, HEAD = 0, 1, 2, 3
#: Elements whose tags format the text of an article; all other tags count.
_FORMATTING = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong small u s q cite mark br td th tr tbody thead table caption blockquote pre code kbd sup sub dl dt dd ol ul li figure figcaption article main section html body head title span".split())
_BOXES = ("nav", "footer")


class _Lines(HTMLParser):
    """Characters of text, of links and tags of each line, and the lines of elements that hold no article."""

    def __init__(self, lines: int) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.tags, self.links, self.boxed = [0] * lines, [0] * lines, [0] * lines, [False] * lines
        self.skip, self.link, self.open = 0, False, []

    def _at(self) -> int:
        return min(self.getpos()[0], len(self.tags)) - 1

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.tags[self._at()] += tag not in _FORMATTING
        self.skip += tag in ("script", "style")
        self.link = tag == "a" or self.link and tag not in ("p", "li", "div", "tr", "td", "h1", "h2", "h3")
        if tag in _BOXES:
            self.open.append((tag, self._at()))

    def handle_endtag(self, tag: str) -> None:
        self.tags[self._at()] += tag not in _FORMATTING
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.link = self.link and tag != "a"
        if self.open and self.open[-1][0] == tag:  # one that is never closed tells nothing
            first = self.open.pop()[1]
            if not self.open:
                self.boxed[first : self._at() + 1] = [True] * (self._at() + 1 - first)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for i, part in enumerate(data.split("\n"), self._at()):
                if i < len(self.text):
                    self.text[i] += len(part.strip())
                    self.links[i] += len(part.strip()) * self.link


_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")


def _events(lines: list[str]) -> tuple[_Lines, bool]:
    """The page's lines as the parser sees them, and whether they hold tags at all; a text without tags is one data event."""
    parser = _Lines(len(lines))
    page = "\n".join(lines)
    tagged = "<" in page and bool(_TAG.search(page))
    if tagged:
        parser.feed(page)
        parser.close()
    else:
        parser.handle_data(page)
    return parser, tagged


# What recurs on other pages


_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[|/•·›»>→←«‹\t]+|[.!?。]\s+|\s\s+")
_EDGES = " []()«‹›»-–•*.!?。"


def parts(line: str, site: str | None) -> list[str]:
    """The parts of a line between separators, and its sentences, lower-cased, with numbers and the site's name made equal."""
    low = _DIGITS.sub("0", line.strip().lower())
    if site and site in low:
        low = low.replace(site, "§")
    found = [p for p in [x.strip(_EDGES) for x in _PARTS.split(low)] if p]
    return found or [low]


def _tells(part: str) -> bool:
    """Whether a part may recur at all: single letters and numbers do everywhere."""
    return len(part) > 4 or len(part) > 1 and (not part.isascii() or any(map(str.isalpha, part)))


def site_name(site: str | None) -> str | None:
    """The first label of a host name that is long enough to be told from other words, lower-cased."""
    name = site.lower().removeprefix("www.").split(".")[0] if site else ""
    return name if len(name) > 3 else None


def _part_hash(part: str) -> int:
    return xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Recurring:
    """Hashes of the parts that recur, and of those among them that introduce lists of titles; ``table`` (part, head) where they are too many for the tasks."""

    known: frozenset[int] = frozenset()
    heads: frozenset[int] = frozenset()
    table: DataFrame | None = field(default=None, compare=False)


def _title_like(line: str) -> bool:
    """Whether a line has the form of an entry in a list of titles: three to fifteen words without the end of a sentence."""
    bare = _MARKER.sub("", line.strip())
    return 3 <= len(bare.split()) <= 15 and not _SENTENCE_END.search(bare) and not bare.endswith(",")


# What a line says by itself


_SIGNS = re.compile(r"[|•·›»→]")
_LINK_SIGN = re.compile(r"\s*[|•·›»→]\s*")
_ENTRY = re.compile(r"[^\W\d_][\w&'’.-]*(?: [\w&'’.-]+){0,2}")
_LABELLED = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)?: ([^.!?]+)$")


def _link_rows(lines: list[str]) -> list[int]:
    """How many entries each line has that is a row of links in plain text, short entries of words; 0 for others, and for rows of tables:
    those beside a line of as many parts."""
    out = [0] * len(lines)
    if not _SIGNS.search("\n".join(lines)):
        return out
    cells = [_LINK_SIGN.split(x.strip()) if _SIGNS.search(x) else [] for x in lines]
    for i, row in enumerate(cells):
        if sum(map(bool, row)) > 3 and all(len(p) <= 40 and _ENTRY.fullmatch(p) and not _SENTENCE_END.search(p) for p in row if p):
            beside = {len(cells[j]) for j in (i - 1, i + 1) if 0 <= j < len(lines)}
            out[i] = 0 if len(row) in beside else len(row)
    return out


def _menu_entries(line: str) -> tuple[int, int]:
    """How many parts a line has between separators, and how many of them are entries of menus."""
    found = [p.strip("[]()«‹ \t").lower() for p in _SPLIT.split(line.strip()) if p and p.strip("-–•*›» \t")]
    return len(found), sum(p in MENU for p in found)


#: First words of the cues and of the heads of teaser lists; other lines are not tried, as most lines are prose.
_FIRST_WORDS = frozenset(
    """skip menu menü menú you sie vous estás está você jesteś вы home startseite accueil inicio início accept reject allow decline agree manage cookie cookies i alle alles ablehnen
    einstellungen tout refuser paramétrer aceptar rechazar configurar aceitar zaakceptuj принять your advertisement anzeige publicité publicidad sponsored ad ads promoted click download sign subscribe
    join share teilen partager compartir compartilhar udostępnij поделиться tweet tweetle like pin email e print whatsapp follow tag tags filed categories category schlagwörter mots
    étiquettes etiquetas tagi теги prev previous next older newer zurück weiter précédent suivant anterior siguiente page load show view c copyright powered all back to nach haut volver leave post report
    related popular most trending more read see recommended latest editor editors don up what à articles les sur das mehr meistgelesen ähnliche lesen weitere artículos también lo más te artigos leia mais veja
    zobacz czytaj najczęściej powiązane может читайте похожие самое""".split()
)
#: Words that a cue holds anywhere.
_ANYWHERE = ("cookie", "クッキー", "rights reserved", "vorbehalten", "droits réservés", "derechos reservados", "direitos reservados", "prawa zastrz", "права защищ", "not responsible for", "©", "関連記事", "おすすめ記事", "人気記事")
_FIRST = re.compile(r"[^\W\d_]+|\d")
_SENTENCES = re.compile(r"(?<=[.!?。])\s+")
_WIDE = re.compile(r"\s\s")


def _notice(line: str) -> bool:
    """Whether a line of several sentences is a notice as a whole: half of its sentences are about cookies."""
    found = _SENTENCES.split(line)
    return len(found) < 4 or 2 * sum("cookie" in p.lower() for p in found) >= len(found)


_BETWEEN = "|/•·›»>→\t"


def kind_of(line: str, anywhere: bool = True) -> int:
    """What the words of a line say: furniture, undecided (a single entry of a menu), the head of a list of titles, or nothing.

    ``anywhere`` is False where the page is known to hold no word of ``_ANYWHERE``.
    """
    bare = line.strip()
    first = _FIRST.search(bare)
    if not first or first.start() > 0 or (word := first.group().lower()) in _FIRST_WORDS or word.isdigit() or anywhere and any(x in bare.lower() for x in _ANYWHERE):
        if _TEASERS.fullmatch(_MARKER.sub("", bare)):
            return HEAD
        if _CUES.match(bare) and _notice(bare):
            return FURNITURE
    if any(x in bare for x in _BETWEEN) or _WIDE.search(bare):
        entries, known = _menu_entries(bare)
        if entries > 1 and known >= max(2, 0.6 * entries):
            return FURNITURE
        if entries == 1 and known:
            return UNDECIDED
    elif len(bare) <= 40 and bare.lower().strip("[]()«‹-–•* ") in MENU:
        return UNDECIDED
    return PLAIN


_WORDS_ONLY = re.compile(r"\w+(?:[.’'-]\w+)*(?: \w+(?:[.’'-]\w+)*){0,3}[.,]?")


def recurring_kind(line: str, site: str | None, seen: Recurring) -> int:
    """What a line is by what recurs: most of its characters in parts that stand on many pages make it furniture; one to four bare words
    may be a subhead as well, so they stay undecided."""
    found = parts(line, site)
    known = [_part_hash(p) for p in found]
    if seen.known.isdisjoint(known):
        return PLAIN
    if len(found) == 1 and known[0] in seen.heads:
        return HEAD
    length = sum(len(p) for p, h in zip(found, known) if h in seen.known and _tells(p))
    if not length or length < 0.6 * sum(map(len, found)):
        return PLAIN
    return UNDECIDED if _WORDS_ONLY.fullmatch(_MARKER.sub("", line.strip())) and "§" not in found[0] else FURNITURE


# Ratio, smoothing, clusters


def line_ratios(texts: list[int], tags: list[float]) -> list[float]:
    """Logarithm of the text-to-tag ratio of each line, 1 added; a line without tags counts as at least ``PLAIN_CHARS`` characters."""
    return [log1p(min((t if g > 0 else max(t, PLAIN_CHARS)) / (1 + g), 200.0)) for t, g in zip(texts, tags)]


@lru_cache(maxsize=16)
def _kernel(sigma: float) -> tuple[float, ...]:
    radius = ceil(3 * sigma)
    weights = [exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return tuple(w / sum(weights) for w in weights)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """The values convolved with a Gaussian; the first and last ones go on beyond the ends."""
    kernel = _kernel(sigma)
    radius = len(kernel) // 2
    padded = [*values[:1] * radius, *values, *values[-1:] * radius]
    return [sum(map(mul, kernel, padded[i : i + len(kernel)])) for i in range(len(values))]


def threshold(values: list[float], rounds: int = 12) -> float:
    """The middle between the means of two clusters."""
    if not len(values):
        return 0.0
    ordered = sorted(values)
    sums = [0.0, *accumulate(ordered)]
    n, low, high = len(ordered), ordered[0], ordered[-1]
    for _ in range(rounds):
        k = bisect_right(ordered, (low + high) / 2)
        if not 0 < k < n:
            break
        new = sums[k] / k, (sums[n] - sums[k]) / (n - k)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


# Lists of titles


def _is_prose(line: str) -> bool:
    bare = line.strip()
    return bool(_INNER_END.search(bare)) or len(bare) > 40 and bool(_SENTENCE_END.search(bare)) or len(bare.split()) > 11 or "。" in bare


def _same_title(line: str, own: set[str]) -> bool:
    """Whether a line is the page's own title but for words put in."""
    low = line.lower()
    return len(own) > 1 and all(w in low for w in own) and not _MARKER.match(line) and own < set(words(line))


def _recurs(line: str, others: list[str], below: list[str]) -> bool:
    """Whether a long word of a line that the other lines of its list lack comes twice in the text below: a title without a known one."""
    there = {w for x in others for w in words(x)}
    rare = [w for w in words(line) if len(w) > 5 and w not in there]
    there = [w for x in below for w in words(x)] if rare else []
    return any(there.count(w) > 1 for w in rare)


def _listed(lines: list[str], numbers: list[int], kinds: list[int], title: str | None) -> list[bool]:
    """The lines of lists of titles: those after a head that have the form of titles, up to prose, the page's own title or a sign of something else."""
    n, out = len(lines), [False] * len(lines)
    own = " ".join(title.split()) if title else None
    own_words = set(words(title)) if title else set()
    i = 0
    while i < n:
        if kinds[i] != HEAD:
            i += 1
            continue
        j = i + 1
        while j < n and kinds[j] in (PLAIN, UNDECIDED) and not _is_prose(lines[j]) and " ".join(lines[j].split()) != own:
            if j > i + 1 and (lines[j][-9:].strip()[-1:] in _ENDS and len(lines[j].split()) > 2 and _SHORT_SENTENCE.search(lines[j][-9:]) or lines[j].count("|") > 1 or "\t" in lines[j].strip()):
                break  # prose of short lines, or a table
            if _same_title(lines[j], own_words):
                break
            if j - i > 2 and j + 1 < n and _is_prose(lines[j + 1]) and not _MARKER.match(lines[j]):
                apart = numbers[j] > numbers[j - 1] + 1 and numbers[j - 1] - numbers[i] == j - 1 - i
                if len(lines[j].split()) <= 2 or apart or not own_words and _recurs(lines[j], lines[i + 1 : j], [x for x in lines[j + 1 :] if _is_prose(x)]):
                    break  # a subhead or the title of the article
            out[j] = True
            j += 1
        if j < n and kinds[j] == PLAIN and _is_prose(lines[j]):
            # a sentence that began on the lines before
            k = j
            while k - 1 > i and lines[k].lstrip()[:1].islower() and not _MARKER.match(lines[k - 1]):
                k -= 1
                out[k] = False
        i = j
    return out


def _mended(lines: list[str]) -> list[str]:
    """The lines with wrong encodings mended in those that are no prose; what prose says is not looked up."""
    at = [i for i, x in enumerate(lines) if not x.isascii() and not _is_prose(x)]
    text = "\n".join(lines[i] for i in at)
    if not is_garbled(text):
        return lines
    again = restore(text).split("\n")
    if len(again) != len(at):
        return lines
    new = dict(zip(at, again))
    return [new.get(i, x) for i, x in enumerate(lines)]


def furniture(body: str | None, title: str | None = None, site: str | None = None, seen: Recurring = Recurring(), mended: bool = False) -> list[int]:
    """Numbers, from 1, of the lines that are page furniture; lines are split at newlines, blank ones are never listed.

    A line equal to ``title``, if known, ends a list of titles before the article. ``seen`` says what recurs on other pages of the
    collection. Short lines are read with wrong encodings mended, unless the body is ``mended`` already.
    """
    if not body or not body.strip():
        return []
    numbers, lines = [], []
    for i, line in enumerate(body.split("\n"), 1):
        if line.strip():
            numbers.append(i)
            lines.append(line)
    parser, tagged = _events(lines)
    if tagged:
        lines = [_TAG.sub(" ", x).strip() for x in lines]
    if not mended and not body.isascii():
        lines = _mended(lines)
    name = site_name(site)
    own = title.strip().lower() if title else None
    low = body.lower()
    anywhere = any(x in low for x in _ANYWHERE)
    kinds = [kind_of(x, anywhere) if x else PLAIN for x in lines]
    if seen.known:
        for i, line in enumerate(lines):
            if kinds[i] in (PLAIN, UNDECIDED) and line and line.strip().lower() != own:
                kinds[i] = recurring_kind(line, name, seen) or kinds[i]
    listed = _listed(lines, numbers, kinds, title) if HEAD in kinds else [False] * len(lines)
    tags: list[float] = [t + x for t, x in zip(parser.tags, parser.links)]
    for i, row in enumerate(_link_rows(lines)):
        text = parser.text[i]
        if parser.boxed[i] or listed[i] or kinds[i] in (FURNITURE, HEAD):
            tags[i] += 10 * max(text, 1)
        elif kinds[i] == UNDECIDED:
            tags[i] += max(text / 3.5 - 1, 1)
        elif row:
            tags[i] += max(row, text / 4)
    ratio = line_ratios(parser.text, tags)
    if tagged:  # tags without text, and scripts, go with the lower of the lines beside them
        texts = [i for i, t in enumerate(parser.text) if t]
        for i, t in enumerate(parser.text):
            if not t and texts:
                after = bisect_right(texts, i)
                ratio[i] = min(ratio[texts[max(after - 1, 0)]], ratio[texts[min(after, len(texts) - 1)]])
    ratio = smoothed(ratio, SIGMA)
    border = min(max(threshold(ratio), LEAST_CUT), MOST_CUT)
    return [number for number, value in zip(numbers, ratio) if value <= border]


def article(body: str | None, title: str | None = None, site: str | None = None, seen: Recurring = Recurring(), mended: bool = False) -> str | None:
    """The body without its furniture; null stays null."""
    if body is None:
        return None
    gone = set(furniture(body, title, site, seen, mended))
    return "\n".join(x for i, x in enumerate(body.split("\n"), 1) if i not in gone)


# Collections


def page_parts(body: str, title: str | None, site: str | None) -> dict[int, bool]:
    """The hashes of the parts of a page's lines, and whether a line of the form of a title, not the page's own, follows a line of that part alone."""
    lines = [x for x in body.split("\n") if x.strip()]
    if any("<" in x for x in lines):
        lines = [y for y in (_TAG.sub(" ", x).strip() for x in lines) if y]
    name, own = site_name(site), " ".join(title.split()) if title else None
    out: dict[int, bool] = {}
    for line, after in zip(lines, [*lines[1:], ""]):
        found = parts(line, name)
        leads = len(found) == 1 and _title_like(after) and " ".join(after.split()) != own
        for p in filter(_tells, found):
            h = _part_hash(p)
            out[h] = out.get(h, False) or leads
    return out


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, page, head) of the distinct parts of each page; ``page`` names its longest line."""
    for batch, bodies in slices(batches, 1):
        at, found, page, heads = [], [], [], []
        for i, (body, title, site) in enumerate(zip(bodies, batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            own = page_parts(body or "", title, site)
            at += [i] * len(own)
            found += own
            heads += own.values()
            page += [_part_hash(max(body.split("\n"), key=len))] * len(own) if own else []
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(3).take(rows), pa.array(found, pa.int64()), pa.array(page, pa.int64()), pa.array(heads, pa.bool_())], names=["record", "site", "part", "page", "head"])


def _parts_of(source: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.where("body is not null").select("record", "body", "title", "site").mapInArrow(_part_batches, f"record {kinds['record']}, site string, part bigint, page bigint, head boolean")


def recurring_parts(source: DataFrame) -> Recurring:
    """What recurs in a table of ``record, body, title, site``: on ``PAGE_SHARE`` of all pages, or on ``SITE_SHARE`` of the pages of a site.

    Counts are combined before each shuffle. Copies of a page count once, so that a group of copies of any size makes nothing recur.
    """
    site = F.coalesce("site", F.lit(""))
    sites = cut(source.where("body is not null").groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("all")), "sites")
    pages = sites.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n")).first()["n"]
    once = _parts_of(source).select("part", "page", F.xxhash64(site).alias("site"), "head").groupBy("part", "page").agg(F.min("site").alias("site"), F.max("head").alias("head"))
    by_site = once.groupBy("part", "site").agg(F.count(F.lit(1)).alias("n"), F.count_if("head").alias("heads"))
    sized = join_sized(by_site, sites.where("site <> ''").select(F.xxhash64("site").alias("site"), "all"), "site", "left", 16)
    often = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= SITE_SHARE * F.col("all"))
    total = sized.groupBy("part").agg(F.sum("n").alias("n"), F.sum("heads").alias("heads"), F.coalesce(F.bool_or(often), F.lit(False)).alias("in_site"))
    table = cut(total.where((F.col("n") >= max(LEAST_PAGES, PAGE_SHARE * pages)) | F.col("in_site")).select("part", (F.col("heads") >= HEAD_SHARE * F.col("n")).alias("head")), "recurring-parts")
    if table.count() > MOST_PARTS:
        return Recurring(table=table)
    rows = [(r["part"], r["head"]) for r in table.toLocalIterator()]
    return Recurring(frozenset(p for p, _ in rows), frozenset(p for p, h in rows if h))


def _with_parts(source: DataFrame, table: DataFrame) -> DataFrame:
    """The rows with the recurring ones among their parts (``known``, ``heads``), joined by shuffle; none is left out."""
    rows = cut(source.withColumn("id", F.monotonically_increasing_id()), "pages")
    found = _parts_of(rows.select(F.col("id").alias("record"), "body", "title", "site")).select(F.col("record").alias("id"), "part").join(table, "part")
    sets = found.groupBy("id").agg(F.collect_set("part").alias("known"), F.collect_set(F.when(F.col("head"), F.col("part"))).alias("heads"))
    return rows.join(sets, "id", "left").select("record", "body", "title", "site", "known", "heads")


def _each(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches with the arguments of ``furniture`` for each row."""
    for batch, bodies in slices(batches, 1):
        columns = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
        seen = [shared.value] * len(bodies) if len(columns) < 4 else [Recurring(frozenset(k or ()), frozenset(h or ())) for k, h in zip(*columns[2:])]
        yield batch, list(zip(bodies, *columns[:2], seen))


def _line_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in _each(batches, shared):
            found = [furniture(*page) for page in pages]
            rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([n for x in found for n in x], pa.int64())], names=["record", "line_no"])

    return run


def _article_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in _each(batches, shared):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([article(*page) for page in pages], pa.string())], names=["record", "article"])

    return run


def _prepared(df: DataFrame, record: str, body: str, title: str | None, site: str | None) -> tuple[DataFrame, object]:
    optional = [(F.col(c) if c else F.lit(None)).cast("string").alias(n) for c, n in ((title, "title"), (site, "site"))]
    source = df.select(F.col(record).alias("record"), F.col(body).alias("body"), *optional)
    seen = recurring_parts(source)
    if seen.table is not None:
        source, seen = _with_parts(source, seen.table), Recurring()
    return source, df.sparkSession.sparkContext.broadcast(seen)


def furniture_lines(df: DataFrame, record: str, body: str, title: str | None = None, site: str | None = None) -> DataFrame:
    """``record, line_no`` of every line of page furniture, once per record.

    Null, empty and blank bodies and bodies without furniture give no row; repeated rows give one; an empty table gives none. Other
    columns are not read. Bodies are shuffled only if more than ``MOST_PARTS`` parts recur.
    """
    source, shared = _prepared(df, record, body, title, site)
    return source.where("body is not null").mapInArrow(_line_batches(shared), f"record {source.schema['record'].dataType.simpleString()}, line_no bigint").distinct()


def articles(df: DataFrame, record: str, body: str, title: str | None = None, site: str | None = None) -> DataFrame:
    """``record, article``: one row per row of ``df`` with the body's main part; null bodies stay null, empty ones empty."""
    source, shared = _prepared(df, record, body, title, site)
    return source.mapInArrow(_article_batches(shared), f"record {source.schema['record'].dataType.simpleString()}, article string")
