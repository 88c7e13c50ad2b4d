"""Problem 4: text that was decoded with a wrong character encoding.

The garbled forms of the usual non-ASCII characters are computed for the pairs of a true and a wrong encoding below and put
into one multi-pattern automaton. Multi-byte encodings read as another one give sequences that no correct text has; they
are evidence by themselves. One-byte encodings read as another give single letters that other languages use; of them the
automaton has what proves a wrong reading between two letters (see ``pair_sequences``), and runs of such letters and
signs that need the line around them are patterns (see ``_WORDS``). Only the matched spans are decoded again, so that
correct text beside them stays; spans whose bytes were lost keep their replacement characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.words import slices

#: Encodings that UTF-8 text is commonly read as. ``cp1252`` and the like keep bytes they do not define as control characters.
WRONG_FOR_UTF8 = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "iso8859-2", "iso8859-15", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "gbk", "cp932", "big5", "euc_kr")
#: Fixed values: (true, wrong) pairs of other encodings.
OTHER_PAIRS = (("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "latin-1"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp932", "latin-1"), ("cp932", "cp1252"), ("euc_jp", "latin-1"), ("gbk", "latin-1"))
_MULTIBYTE = ("gbk", "cp932", "big5", "euc_kr")
_ALPHABET = "".join(map(chr, [*range(0xA1, 0x180), *range(0x386, 0x3CF), *range(0x401, 0x460), *range(0x2010, 0x2027), 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122, 0x2190, 0x2191, 0x2192, 0x2193, 0x2630, *range(0x3000, 0x3003), *range(0x3041, 0x3097), *range(0x30A1, 0x30FD)]))
#: Characters that correct text puts beside letters; a sequence of only these and letters proves less.
_LETTERS = frozenset(_ALPHABET)
_MARKS = "".join(map(chr, (*range(0x2013, 0x201F), 0xAB, 0xBB)))
_USUAL = {chr(c) for c in (*range(0x2013, 0x201F), 0x2026, 0x2039, 0x203A, 0x20AC, 0x2122, 0xA0, 0xA1, 0xA7, 0xA8, 0xA9, 0xAA, 0xAB, 0xAE, 0xB0, 0xB4, 0xB7, 0xBA, 0xBB, 0xBF, 0x2022)}


def to_bytes(text: str, encoding: str) -> bytes:
    """``text`` in ``encoding``; characters below 256 that it lacks stand for the byte they number (control characters do)."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if ord(c) > 255:
                    raise
                out.append(ord(c))
        return bytes(out)


def from_bytes(data: bytes, encoding: str) -> str:
    """``data`` read as ``encoding``; undefined bytes of one-byte encodings become control characters."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        if encoding in _MULTIBYTE:
            raise
        return "".join(_one(b, encoding) for b in data)


@lru_cache(maxsize=8192)
def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def garbled_sequences() -> dict[str, tuple[set[str], bool]]:
    """Garbled sequence -> the wrong encodings that give it, and whether it proves a wrong reading by itself."""
    out: dict[str, tuple[set[str], bool]] = {}
    for wrong in WRONG_FOR_UTF8:
        for c in _ALPHABET:
            try:
                seen = from_bytes(c.encode(), wrong)
            except UnicodeDecodeError:
                continue
            if len(seen) > 1 or wrong in ("gbk", "big5", "euc_kr"):
                names, _ = out.setdefault(seen, (set(), _proves(seen)))
                names.add(wrong)
    # UTF-8 read as GBK or Shift-JIS: leads of punctuation and kana, whose last byte pairs with what follows
    for seen, wrong in (("鈥", "gbk"), ("銇", "gbk"), ("銈", "gbk"), ("銉", "gbk"), ("縺", "cp932"), ("繧", "cp932"), ("繝", "cp932"), ("窶", "cp932")):
        out[seen] = ({wrong}, True)
    return out


#: Signs that correct text puts between letters, or that need more than the letters beside them as proof.
_AMID = frozenset("‘’“”–—…•·´`¨¸ªº°¹²³®™©§&¡¿«»¶\xa0\xad")
#: Letters that stand in either case.
_ANY_CASE = frozenset("ßıĸŉªº")
_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _odd_between(true: str, seen: str) -> tuple[bool, bool]:
    """Whether ``seen``, which stands for the letter ``true``, proves a wrong reading between two small and two capital Latin letters."""
    if not true.isalpha() or seen == true or seen.isascii() or seen in _AMID or seen in _ANY_CASE or 0x80 <= ord(seen) < 0xA0:
        return False, False  # control characters are proof anywhere, see ``_WORDS``
    if not seen.isalpha() or seen == "ˆ" or "Ͱ" <= seen <= "ӿ":
        return True, True
    return seen.isupper(), seen.islower()


@lru_cache(maxsize=1)
def pair_sequences() -> dict[str, tuple[bool, set[tuple[str, str]]]]:
    """Garbled sequence -> whether it is one whatever follows, and the pairs of ``OTHER_PAIRS`` that give it: a letter and a character that no word
    has after it (see ``_ends_odd`` for what must follow). A low quote right after a letter is one anyway.

    Letters that stay letters of the same case and script prove nothing by one; runs of them are in ``_WORDS``.
    """
    out: dict[str, tuple[bool, set[tuple[str, str]]]] = {}
    for true, wrong in OTHER_PAIRS:
        if true in ("cp932", "euc_jp", "gbk"):
            continue
        for b in range(0x80, 0x100):
            letter, seen = _one(b, true), _one(b, wrong)
            low = letter.isalpha() and seen in "‚„"
            for odd, letters in zip(_odd_between(letter, seen), (_SMALL, _SMALL.upper())):
                for before in letters if odd or low else "":
                    out.setdefault(before + seen, (low, set()))[1].add((true, wrong))
    return out


def _ends_odd(seen: str, after: str) -> bool:
    """Whether what follows a sequence of ``pair_sequences`` leaves no other reading: a letter of the same case (any, where the character is a sign), or no letter after a capital amid small ones."""
    if seen[0].islower():
        return after.islower() or seen[1].isupper() and seen[1] < "Ͱ" and not after.isalnum()
    return after.isupper() or after.islower() and (not seen[1].isalpha() or seen[1] == "ˆ")


def _proves(seen: str) -> bool:
    sign = lambda c: not c.isalpha() and c not in _USUAL or 0x80 <= ord(c) < 0xA0
    return len(seen) > 2 or len(seen) > 1 and any(map(sign, seen))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for seen, (wrong, proves) in garbled_sequences().items():
        found.add_word(seen, (len(seen), tuple(sorted(wrong)), proves, ()))
    for seen, (anyway, pairs) in pair_sequences().items():
        found.add_word(seen, (len(seen), (), anyway, tuple(sorted(pairs))))  # UTF-8 gives none that begins with an ASCII letter
    found.make_automaton()
    return found


#: Words that no correct text has, with the pairs of encodings to try for them.
_LATIN, _CYRILLIC = "A-Za-zÀ-ÖØ-öø-ɏ", "Ѐ-ӿ"
_WORDS = [
    # several accented letters or signs in a row: Cyrillic or East Asian bytes read as Latin
    (re.compile(r"[¡-ÿ]{4,}|(?<![A-Za-zÀ-ÿ])[À-ÿ]{3,}(?![A-Za-zÀ-ÿ])"), ("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("cp866", "latin-1"), ("euc_jp", "latin-1"), ("gbk", "latin-1")),
    # signs inside Latin words: Central European bytes read as Western
    (re.compile(rf"[{_LATIN}][¹³¿¶±¼¾¦]+(?=[{_LATIN}])|(?<![\w¿])[¹³¿¶±¼¾](?=[a-zà-ÿ]{{2}})(?![^\n]{{0,160}}\?)|[a-z]{{2}}[¹³¶±](?![\w])|[a-z]œ(?![a-z])|[aeiuyklwz]œ[a-z]|(?<!\w)[ŒŸ][bcdfghjklmpqrtvwxz]"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1")),
    # a letter of the other case amid a word, or Latin mixed with Cyrillic or Greek in a word
    (re.compile(r"[a-zß-ÿ][À-ÖØ-ÞŠŽ][a-zß-ÿ]"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252")),
    (re.compile(rf"[a-zA-Z][{_CYRILLIC}][a-zA-Z]|(?<!\w)[{_CYRILLIC}][a-z]{{2}}|[a-z]{{2}}[{_CYRILLIC}](?!\w)"), ("cp1252", "cp1251")),
    (re.compile(r"[a-zA-Z][Ͱ-Ͽ][a-z]|(?<=[a-z]{3})(?<!sin)(?<!cos)(?<!tan)Θ(?!\w)"), ("cp1252", "cp437")),
    (re.compile(r"[а-яё][А-ЯЁ]{2,}|(?<!\w)[А-ЯЁ]{2,}[а-яё]+[А-ЯЁ]"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")),
    (re.compile(r"[а-яёЀ-Џѐ-џ][¤¬¦\xad]|[¤¬¦\xad][а-яё]|[а-яё]®[а-яё]|[а-яё][Ґ«»©§][а-яёЄ]|[а-яё][ҐЁЄЎЇ][а-яёЁЄ\xad]|[а-яё]{2}[ҐЄЎЇ]|[а-яё][ўҐ]{2}"), ("cp866", "cp1251")),
    (re.compile(r"[A-Za-zА-я][─-╿]|[─-╿][A-Za-zА-я]"), ("cp1251", "cp866"), ("utf-8", "cp866"), ("utf-8", "cp437")),
    # control characters, or low quotes where a space must stand: Shift-JIS bytes
    (re.compile(r"[\x80-\x84\x86-\x9f]"), ("cp932", "latin-1"), ("mac_roman", "latin-1")),
    (re.compile(r"(?:‚[^\s‚]){3}"), ("cp932", "cp1252")),
    # closing quotes amid words of a text that quotes nothing (or three of them: one may be a typing error), an opening mark of Spanish without its closing one: letters of DOS
    (re.compile(r"\A(?![\s\S]*(?<!\w)[“”„]\w)[\s\S]*?[a-z]”[a-z]|(?:[a-z]”[a-z][\s\S]*?){3}|[a-z]¡[a-z](?![^\n]{0,160}!)"), ("cp437", "cp1252"), ("cp850", "cp1252")),
]
_LOST = "\ufffd"


def _range(*pairs: tuple[int, int]) -> frozenset[str]:
    return frozenset(chr(c) for a, b in pairs for c in range(a, b + 1))


#: A pattern of ``_WORDS`` is tried only if the text holds one of these characters.
_NEEDS = [_range((0xA1, 0xFF)), frozenset("¹³¿¶±¼¾¦œŒŸ"), _range((0xC0, 0xDE)) | set("ŠŽ"), _range((0x400, 0x4FF)), _range((0x370, 0x3FF)), _range((0x400, 0x4FF)), frozenset("¤¬®Ґґ§¦©«»") | {"\xa0", "\xad"} | _range((0x400, 0x40F), (0x450, 0x45F), (0x462, 0x4FF)), _range((0x2500, 0x257F)), _range((0x80, 0x84), (0x86, 0x9F)), frozenset("‚"), frozenset("”¡")]
#: A text whose characters beyond ASCII are all among these holds nothing to look for.
_SAFE = frozenset("–—‘’“”…•›»☰↑✓§°·")


def _word_signs(text: str, characters: set[str]) -> bool:
    return any(not characters.isdisjoint(need) and pattern.search(text) for need, (pattern, *_) in zip(_NEEDS, _WORDS))


_BEYOND = re.compile(r"[^\n]?[^\x00-\x7f]+(?:[^\n][^\x00-\x7f]+)*[^\n]?")


def evidence(text: str) -> tuple[Counter, bool]:
    """Wrong readings of UTF-8 by how many sequences of theirs occur, and whether the text is garbled at all."""
    votes: Counter = Counter()
    proofs, weak, last = 0, 0, -9
    text = "\n".join(_BEYOND.findall(text))  # all sequences lie beyond ASCII; the automaton is slow on what cannot match
    for end, (size, wrong, proves, pairs) in _automaton().iter(text):
        start = end - size + 1
        if pairs:
            proofs += proves or _ends_odd(text[start : end + 1], text[end + 1 : end + 2])
            continue
        before = text[start - 1] if start else " "
        first = text[start]
        if size == 1 and not proves:
            # one ideograph for an accented letter or a Cyrillic one: only amid Latin letters, or beside another such
            near = text[end + 1] if end + 1 < len(text) else " "
            sides = (before.isascii() and before.isalpha()) + (near.isascii() and near.isalpha())
            if not sides:
                continue
            if sides == 2 and near.islower():
                proofs += 1
            weak += 1
        elif proves or not (before.isupper() or first in _MARKS) and not ("Ѐ" <= first <= "ӿ" and text[end] in _USUAL):
            proofs += 1
        else:
            weak += 1
            if start == last + 1:
                weak += 1
        last = end
        votes.update(wrong)
    return votes, proofs > 0 or weak > 2


def pair_votes(text: str) -> Counter:
    """The pairs of ``OTHER_PAIRS`` by how many of their sequences occur."""
    votes: Counter = Counter()
    text = "\n".join(_BEYOND.findall(text))
    for end, (_, _, proves, pairs) in _automaton().iter(text):
        if pairs and (proves or _ends_odd(text[end - 1 : end + 1], text[end + 1 : end + 2])):
            votes.update(pairs)
    if _WORDS[-1][0].search(text):
        votes.update(_WORDS[-1][1:])
    return votes


def is_garbled(text: str | None) -> bool:
    """Whether the text holds characters from reading it in a wrong encoding. Null, empty and ASCII texts do not."""
    if not text or text.isascii():
        return False
    characters = {c for c in set(text) if not c.isascii()}
    if characters <= _SAFE:
        return "”" in characters and bool(_WORDS[-1][0].search(text))
    return _LOST in characters or evidence(text)[1] or _word_signs(text, characters)


def _high(wrong: str) -> str:
    """A character class of what ``wrong`` makes of bytes above 127."""
    return "[" + "".join(sorted({re.escape(_one(b, wrong)) for b in range(0x80, 0x100)} | {chr(b) for b in range(0x80, 0xA0)})) + "]"


@lru_cache(maxsize=32)
def _runs(wrong: str) -> re.Pattern:
    if wrong in _MULTIBYTE:
        return re.compile(r"[^\x00-\x7f]+[\x20-\x7e]?")
    return re.compile(_high(wrong) + "{2,}")


def _reread(run: str, wrong: str) -> str:
    """A span read again as UTF-8: the longest decodable parts, the rest as it is."""
    out, i = [], 0
    while i < len(run):
        for j in range(min(len(run), i + 4), i, -1):
            try:
                got = to_bytes(run[i:j], wrong).decode()
            except UnicodeError:
                continue
            if len(got) == 1 and (j > i + 1 or wrong in _MULTIBYTE) and (got in _LETTERS or got >= "\u2e80" or "\x80" <= got <= "\xa0"):
                out.append(got)
                i = j
                break
        else:
            out.append(run[i])
            i += 1
    return "".join(out)


#: The letters beyond ASCII that are the most frequent ones; of two readings the one with more of them is taken.
_OFTEN_CYRILLIC, _OFTEN_LATIN = "оеаинтсрвл", "éèàáíóúüöäñçêãß"
_WORD_RUN = re.compile(r"[^ \t\r\n]+")


def _plain(word: str, before: str) -> bool:
    """Whether a word read again is more plausible: letters of one script."""
    letters = [c for c in word if c.isalpha()]
    scripts = {("c" if "Ѐ" <= c <= "ӿ" else "l" if c < "ɐ" else "o") for c in letters}
    odd = sum(1 for c in word if not c.isalnum() and c not in _USUAL and ord(c) > 127)
    if not letters or len(scripts) > 1 or odd or word == before:
        return False
    # a word of small letters does not become one of capitals, nor is a capital left amid small letters
    return not (before.islower() and word.isupper()) and not re.search(r"[^\W\d_](?<=[a-zß-ÿа-яё])[A-ZÀ-ÞА-ЯЁ]", word)


def _utf8_again(text: str) -> str:
    """Text whose UTF-8 was read as another encoding, read again as long as that gives anything."""
    while True:  # every pass makes one character of several, so it ends
        votes, found = evidence(text)
        if not found:
            return text
        for wrong, _ in sorted(votes.items(), key=lambda x: (-x[1], WRONG_FOR_UTF8.index(x[0]))):
            new = _runs(wrong).sub(lambda m: _reread(m.group(), wrong), text)  # noqa: B023
            if len(new) < len(text):
                break
        else:
            return text
        text = new


def restore(text: str) -> str:
    """The original text where its bytes are still known, however often it was garbled; correct spans are left as they are."""
    if not _NEEDS[8].isdisjoint(text) and (len(again := _utf8_again(text)) == len(text) or is_garbled(again)):
        text = re.sub(r"[\x20-\xff]+", _japanese, text)
    first, *pairs = _WORDS[0]
    if len(first.findall(text)) > sum(evidence(text)[0].values()):
        cyrillic = {pair: _whole(text, *pair, first) for pair in pairs if pair[0] in ("cp1251", "koi8-r", "cp866")}
        best = max(cyrillic.values(), key=lambda x: sum(map(x.count, _OFTEN_CYRILLIC)))
        text = best
        for pair in pairs[len(cyrillic) :]:
            text = _whole(text, *pair, first)
    text = _utf8_again(text)
    votes = pair_votes(text)
    if votes:
        read = [new for pair, _ in votes.most_common() if (new := _whole(text, *pair, _WORDS[2][0])) != text]
        text = max(read, key=lambda x: (not is_garbled(x), sum(map(x.count, _OFTEN_LATIN))), default=text)
    for pattern, *pairs in _WORDS:
        if pattern.search(text):
            for true, wrong in pairs:
                new = _whole(text, true, wrong, pattern)
                if new != text:
                    text = new
                    break
    return text


def _japanese(m: re.Match) -> str:
    """A run of Shift-JIS bytes read as Latin-1, if that is what it is."""
    try:
        new = to_bytes(m.group(), "latin-1").decode("cp932")
    except UnicodeError:
        return m.group()
    return new if len(re.findall("[ぁ-ん]", new)) > 1 and not evidence(new)[1] else m.group()


def _whole(text: str, true: str, wrong: str, pattern: re.Pattern) -> str:
    """Words read again in another encoding, if the garbled ones among them become plain."""

    def word(m: re.Match) -> str:
        w = m.group()
        if w.isascii():
            return w
        try:
            new = to_bytes(w, wrong).decode(true)
        except UnicodeError:
            return w
        return new if _plain(new, w) and not pattern.search(new) else w

    if true in ("cp932", "euc_jp", "gbk"):

        def run(m: re.Match) -> str:
            try:
                return to_bytes(m.group(), wrong).decode(true)
            except UnicodeError:
                return m.group()

        return re.sub(r"[^\n]+", run, text)
    return _WORD_RUN.sub(word, text)


def _batches(restoring: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 2):
            at = [i for i, t in enumerate(texts) if is_garbled(t)]
            rows = pa.array(at, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows)]
            if restoring:
                fixed = [restore(texts[i]) for i in at]
                columns += [pa.array(fixed, pa.string()), pa.array([not is_garbled(x) for x in fixed])]
            yield pa.RecordBatch.from_arrays(columns, names=["record", "field", "restored", "complete"][: len(columns)])

    return run


def garbled_fields(df: DataFrame, record: str, fields: list[str], restoring: bool = False) -> DataFrame:
    """``record, field`` of every field that holds garbled characters, with ``restored`` text and whether it is ``complete`` on request.

    Null, empty and ASCII texts are no case; repeated rows give one row; an empty table gives none. No column but
    the named ones is read, and texts are not shuffled.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    rows = df.select(F.col(record).alias("record"), each.alias("x")).select("record", "x.field", "x.text").where("text rlike '[^\\\\x00-\\\\x7F]'")
    kind = rows.schema["record"].dataType.simpleString()
    found = rows.mapInArrow(_batches(restoring), f"record {kind}, field string" + ", restored string, complete boolean" * restoring)
    return found.distinct()
