"""Problem 9: text that was decoded with a wrong encoding.

Round-trip repair: stretches of a text are re-encoded under each candidate legacy encoding and strictly decoded as the
encoding that was meant; this is repeated for nested layers, and a step is accepted only where a garbling cost drops. The
cost counts control characters, symbols within words, letters foreign to the text's language, scripts mixed in a word and
capitals after small letters.

Scale. Every text is repaired by itself and whole, in one scan without a shuffle; texts that hold only letters and signs
that any repair would leave alone are passed on after one search.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from citelens.llm.function_words import SETS as FUNCTION_WORDS
from citelens.llm.lines import map_many
from citelens.staging import spread

#: Encodings that UTF-8 text is wrongly read as.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
#: (read as, meant) of texts in an encoding of one byte each.
SINGLE_BYTE = (
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"),
)

# Letters beyond ASCII of each language.
LETTERS = {
    "de": "äöüßÄÖÜ",
    "en": "",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíóúüñÁÉÍÓÚÜÑªº",
    "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚªº",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "cs": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ",
    "tr": "çğıöşüâîûÇĞİÖŞÜ",
}
LETTERS["ru"] = "".join(map(chr, range(0x410, 0x450))) + "ёЁ"
LETTERS["el"] = "".join(map(chr, range(0x386, 0x3CF)))
#: So many different small letters that the first language lacks show that a text holds another one too.
_OWN_LETTERS = 4
_VOWELS = frozenset("аеёиоуыэюя")
_BASIC_OTHER = frozenset(LETTERS["ru"] + LETTERS["el"])
_WEST = frozenset("".join(LETTERS.values())) - _BASIC_OTHER
_LETTERS = {k: frozenset(v) for k, v in LETTERS.items()}
#: Signs that stand in any text.
_USUAL = frozenset("„“”‚‘’«»‹›–—…€°²³§·•×÷±½¼¾\u00a0©®™£µ†¹ªº¿¡№")
#: Signs that may stand between letters.
_JOINING = frozenset("’‘'–—-./\u00ad\u200b\u200d")
#: Signs that alone are no reason to look closer.
_CALM = frozenset("„“”‘’–—€²…°äöüßÄÖÜ")
#: Signs that stand between letters where a blank was left out.
_QUOTES = frozenset("„“”…«»‹›")
_EMPTY_QUOTES = frozenset(["«»", "„“", "“”", "‚‘", "‘’", "‹›"])

_UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: A currency sign read as a letter, or a sign within a word.
_HIDDEN_SIGN = re.compile("\\d\\s?[ÄÇ](?!\\w)|[a-z][²°„”][a-z]|[a-z][À-ÖØ-ÞŠŽŸŒ][a-z]|â€")
#: Cyrillic read as Western: letters beyond ASCII in a row, which no Western word has so many of.
_CYRILLIC_RUN = re.compile("[À-ÖØ-öø-ÿ¸¨÷×]{4,}")
_CYRILLIC_WORD = re.compile("[À-ÿ¸¨]+")
#: What is left of a sequence without its last byte.
_LOST = re.compile("�|[a-zäöüß][ÃÂ](?![A-ZÀ-Þ])|(?<!\\w)Ã(?=[a-z])|â€")
_WITHIN = re.compile("[a-z][À-ÖØ-ÞŠŽŸŒ§²³°„”¹º¼½¾¿¡¢£¤¥¦¨©ª¬®¯±´µ¶¸†‡‰•™ˆ˜][a-zšœž§]|[\x80-\x9f]|[šœž][§][a-z]")
_PART_OF_UTF8 = re.compile("[ÃÂâ][\x80-\xbf€-™œšžŸŒŠŽƒˆ˜]|[ÑÐñð][\x80-\xbf€-™]")
_DASHES = frozenset("–—")
#: English contractions, which letters can't be part of; and those that lost the rest of a sequence.
_CONTRACTED = re.compile(r"(?:\w+n’t|(?:%s)’(?:s|d|m|ll|re|ve))\W*" % "|".join(sorted(FUNCTION_WORDS["en"])), re.I)
_LOST_CONTRACTED = re.compile(r"(?<!\S)â(?!\S)|\b(?:\w+nât|(?:%s)â(?:s|d|m|ll|re|ve))\b" % "|".join(sorted(FUNCTION_WORDS["en"])), re.I)
_TOKEN = re.compile(r"\S*[^\x00-\x7f\s]\S*")


def _bytes_of(encoding: str) -> dict[str, str]:
    """Each character beyond ASCII as its byte (a character below 256), with unassigned bytes as controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = chr(b)
        except UnicodeDecodeError:
            table.setdefault(chr(b), chr(b))
    return table


def _translation(table: dict[str, str]) -> dict[int, str]:
    """For str.translate; what the encoding lacks becomes a sign that no pattern matches."""
    return {c: "￿" for c in range(0x80, 0x100)} | {ord(k): v for k, v in table.items()}


def _lowered() -> dict[str, str]:
    """cp1252 as it comes out after lower-casing: capital lead bytes win over small letters."""
    table = _bytes_of("cp1252")
    upper = {k.lower(): v for k, v in table.items() if k != k.lower() and "\xc0" <= v <= "\xdf"}
    return table | upper | {"ÿ": "\x9f"}


def _codec(name: str, table: dict[str, str]) -> tuple[str, dict[int, str], frozenset[str]]:
    return name, _translation(table), frozenset(k for k, v in table.items() if "\xc2" <= v <= "\xf4")


#: (name, translation, characters that stand for a first byte)
_CODECS = [_codec(name, _bytes_of(name)) for name in READ_AS] + [_codec("lower cp1252", _lowered())]


def _single(read: str, meant: str) -> dict[int, str]:
    """Each character as it was meant; what latin-1 reads as a control is one in cp1252 too."""
    table = _bytes_of(read) | ({chr(b): chr(b) for b in range(0x80, 0xA0)} if read == "cp1252" else {})
    return {ord(k): bytes([ord(v)]).decode(meant, "replace") for k, v in table.items()}


#: (table, whether the text was read as cp1252, so that garbled letters are ordinary ones)
_SINGLES = [(_single(read, meant), read == "cp1252") for read, meant in SINGLE_BYTE]
_CYRILLIC = _single("cp1252", "cp1251")


@lru_cache(4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def letters_of(text: str) -> frozenset[str]:
    """The letters beyond ASCII of the text's language: the one with the most of its function words and small letters.

    Of languages that are even, all letters, and of those in mixed texts that show several letters of their own; with less than
    two signs of any, those of all Western languages.
    """
    words = set(text.lower().split())
    seen = {c for c in "".join(x for x in text.split() if x.isalpha()) if c > "\x7f" and c.islower()}
    counts = {k: 2 * len(known & words) + len(_LETTERS[k] & seen) for k, known in FUNCTION_WORDS.items()}
    most = max(counts.values())
    if most < 2:
        return _WEST
    best = _union(tuple(k for k, n in counts.items() if n == most))
    others = tuple(k for k in counts if len((_LETTERS[k] & seen) - best) >= _OWN_LETTERS)
    return best | _union(others) if others else best


@lru_cache(1024)
def _union(languages: tuple[str, ...]) -> frozenset[str]:
    return frozenset().union(*(_LETTERS[k] for k in languages))


def _letter(c: str) -> bool:
    """Whether a character is a letter of a word, which a modifier such as ˆ isn't."""
    return c.isalpha() and not "\u02b0" <= c <= "\u02ff"


def garbling_cost(part: str, before: str, after: str, own: frozenset[str]) -> float:
    """Cost of ``part`` between the characters ``before`` and ``after``; ``own``: the language's letters."""
    cost = 0.0
    last = before
    end = len(part) - 1
    for i, c in enumerate(part):
        following = part[i + 1] if i < end else after
        if c < "\x80":
            last = c
            continue
        if "\x80" <= c <= "\x9f" or c == "�" or "" <= c <= "":
            cost += 3
        elif _letter(c):
            if c not in own and c not in _USUAL:
                cost += 0.1 if c in _BASIC_OTHER else 0.5 if c in _WEST else 1
            if last.isalpha():
                if c.isupper() and last.islower():
                    cost += 1
                if _script(c) != _script(last):
                    cost += 2
            elif c == "ß":
                cost += 2
        elif last.isalpha() and following.isalpha():
            cost += 0 if c in _JOINING else 2
        elif c not in _USUAL:
            cost += 0.5
        if last + c in _EMPTY_QUOTES:
            cost += 2
        last = c
    return cost


def _utf8_step(text: str, table: dict[int, str], own: frozenset[str], lower: bool) -> tuple[str, float]:
    """The text with every stretch decoded whose cost drops, and the sum of the drops."""
    coded = text.translate(table)
    out, at, gain = [], 0, 0.0
    for m in _UTF8.finditer(coded):
        start, end = m.span()
        meant = m[0].encode("latin-1").decode("utf-8")
        if lower:
            meant = meant.lower()
        before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
        drop = garbling_cost(text[start:end], before, after, own) - garbling_cost(meant, before, after, own)
        if before.isalpha() and after.isalpha() and meant.isalpha() and not any(map(_letter, text[start:end])):
            drop += 1  # signs alone between letters
        if drop >= 0.5:
            out += [text[at:start], meant]
            at, gain = end, gain + drop
    return "".join([*out, text[at:]]), gain


def _telling(word: str, meant: str, own: frozenset[str], ordinary: bool) -> bool:
    """Whether some change can't be chance: a sign within a word, or a foreign letter that becomes one of the language."""
    for i, (a, b) in enumerate(zip(word, meant)):
        if a == b or a < "\x80":
            continue
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        if not _letter(a) and before.isalpha() and after.isalpha() and (b.isalpha() or b in _JOINING):
            if not ordinary or a not in _QUOTES or b in own and before.islower() and after.islower():
                return True
        if a.isupper() and before.islower() and after.islower() and (b in _JOINING and a not in own or ordinary and b.islower() and b in own):
            return True
        if len(word) == 1 and b in _DASHES and a not in own:
            return True
        if b == "’" and a not in own and _CONTRACTED.fullmatch(word[:i] + b + word[i + 1 :]):
            return True
        if own is _WEST or a in own or a in _USUAL or b not in own:
            continue
        if b.islower() and (before.isalpha() or after.islower()) or not a.isalpha() and after.islower():
            return True
    return False


def _single_step(text: str, table: dict[int, str], ordinary: bool, own: frozenset[str]) -> tuple[str, float]:
    """Words whose every letter beyond ASCII has a meaning in the other encoding, where that lowers the cost.

    Where garbled letters are ``ordinary`` ones, some word must hold what no word does: a control, sign or capital within it.
    """
    out, at, gain = [], 0, 0.0
    if ordinary and not _WITHIN.search(text):
        return text, gain
    for m in _TOKEN.finditer(text):
        word = m[0]
        if own.issuperset(c for c in word if c > "\x7f") and not (len(word) < 4 and word[0] in "ÄÇ"):
            continue
        meant = "".join(table.get(ord(c), "\ufffd") if c > "\x7f" else c for c in word)
        if "\ufffd" in meant or "„" in meant and own.isdisjoint("ßłř"):
            continue
        if ordinary and (_PART_OF_UTF8.search(word) or any(b not in own and b not in _USUAL for b in meant if b > "\x7f")):
            continue
        money = word[0] in "ÄÇ" and meant[0] == "€" and re.search(r"\d\s?\Z", text[max(0, m.start() - 3) : m.start()])
        if not money and not _telling(word, meant, own, ordinary):
            continue
        drop = garbling_cost(word, " ", " ", own) - garbling_cost(meant, " ", " ", own) + bool(money)
        if drop >= 0.5 and all(b in own or b in _USUAL or b in _WEST for a, b in zip(word, meant) if a > "\x7f"):
            out += [text[at : m.start()], meant]
            at, gain = m.end(), gain + drop
            if own is _WEST:  # without a known language, German letters are likelier
                gain += 0.01 * sum(b in _LETTERS["de"] for b in meant)
    return "".join([*out, text[at:]]), gain


def _cyrillic_step(text: str) -> tuple[str, int]:
    """The text with its words read as cp1251, if these are Cyrillic beyond chance, and the number of such words."""
    runs = _CYRILLIC_RUN.findall(text)
    meant = [x.translate(_CYRILLIC) for x in runs]
    sound = [x for x in meant if _LETTERS["ru"].issuperset(x) and (x[1:].islower() or x.isupper()) and not _VOWELS.isdisjoint(x.lower())]
    if len(sound) < len(runs) or len(sound) < 2 and max(map(len, sound), default=0) < 6:
        return text, 0
    return _CYRILLIC_WORD.sub(lambda m: m[0].translate(_CYRILLIC), text), len(sound)


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """(text, layers taken off, lost): the restored text; lost: some of it is garbled beyond repair."""
    if not text or text.isascii():
        return text, 0, False
    signs = {c for c in set(text) if c > "\x7f"}
    odd = signs - _CALM
    if not odd and not _HIDDEN_SIGN.search(text):
        return text, 0, False
    own = letters_of(text)
    cyrillic = bool(_CYRILLIC_RUN.search(text))
    if odd <= own and "Ã" not in odd and "Â" not in odd and not cyrillic and not _HIDDEN_SIGN.search(text):
        return text, 0, False
    layers = 0
    while True:  # a step shortens the text or lowers its cost
        best: tuple[str, float] = (text, 0.0)
        for name, table, leads in _CODECS:
            if not leads.isdisjoint(signs):
                step = _utf8_step(text, table, own, name.startswith("lower"))
                if step[1] > best[1]:
                    best = step
        if not best[1] and cyrillic:
            best = _cyrillic_step(text)
            cyrillic = False
        if not best[1]:
            best = max((_single_step(text, *single, own) for single in _SINGLES), key=lambda x: x[1])
        if not best[1]:
            return text, layers, bool(_LOST.search(text)) or "â" in signs - own and bool(_LOST_CONTRACTED.search(text))
        text, layers = best[0], layers + 1
        own = letters_of(text)
        signs = {c for c in set(text) if c > "\x7f"}


def _document(doc_id: int | None, text: str | None) -> list[tuple]:
    fixed, layers, lost = repair(text)
    return [(doc_id, fixed, layers, lost)] if layers or lost else []


def _all_documents(doc_id: int | None, text: str | None) -> list[tuple]:
    return [(doc_id, *repair(text))]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("layers", pa.int32()), ("lost", pa.bool_())])
_DDL = "doc_id bigint, text string, layers int, lost boolean"


def _run(documents: DataFrame, rows: Callable[..., list[tuple]]) -> DataFrame:
    return map_many(spread(documents.select("doc_id", "text")), rows, _SCHEMA, _DDL)


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, layers, lost) of the documents with a garbled stretch; text is restored as far as it can be.

    Null, empty and blank texts are never garbled. Repeated rows are judged each by itself; further columns are ignored.
    """
    return _run(documents, _document)


def restored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, layers, lost) of every document; a null text stays null."""
    return _run(documents, _all_documents)
