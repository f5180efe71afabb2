"""Ukrainian spelling repair and stress marks.

A stress mark is U+0301 after the vowel. The lexicon is a small table; further
dictionaries plug in as functions from word to marked word.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "́"
VOWELS = "аеєиіїоуюяАЕЄИІЇОУЮЯ"
#: Characters that stand for an apostrophe, and words' heads that lack one.
APOSTROPHES = "’‘ʼ＇`"
REPAIRS = [
    (r"\b(пам)(?=[яюєї])", "пам'"), (r"\b(зв)я(?=[зж])", "зв'я"), (r"\b(ім)(?=я)", "ім'"), (r"\b(кров)(?=ю)", "кров'"), (r"\b(м)яс", "м'яс"),
    (r"\b(в)я(?=[зжснлтд])", "в'я"), (r"\b(п)ят", "п'ят"), (r"\b(об)є", "об'є"), (r"\b(під)ї", "під'ї"), (r"\b(роз)ї", "роз'ї"),
    (r"\b(з)ї", "з'ї"), (r"\b(з)яв", "з'яв"), (r"\b(з)єд", "з'єд"), (r"\b(б)є", "б'є"), (r"\b(в)ю", "в'ю"),
]
WORD = re.compile(r"[A-Za-zА-Яа-яЁёІіЇїЄєҐґ'’ʼ́-]+")
_REPAIRS = [(re.compile(p, re.IGNORECASE), r) for p, r in REPAIRS]


def _first_upper(s: str) -> str:
    at = next((k for k, c in enumerate(s) if c.isalpha()), None)
    return s if at is None else s[:at] + s[at].upper() + s[at + 1 :]


def _cased(head: str, new: str) -> str:
    if head.isupper():
        return new.upper()
    return _first_upper(new) if head[:1].isupper() else new


def repair_apostrophes(text: str | None) -> str | None:
    """One kind of apostrophe, spacing acutes as stress marks after letters, lost apostrophes back."""
    if not text:
        return text
    text = text.translate({ord(c): "'" for c in APOSTROPHES})
    text = re.sub(r"(?<=[А-Яа-яІіЇїЄєҐґA-Za-z])´", MARK, text).replace("´", "'")
    for pattern, new in _REPAIRS:
        text = pattern.sub(lambda m, new=new: _cased(m[1], new), text)
    return text


def key(word: str) -> str:
    return word.replace(MARK, "").replace("’", "'").casefold()


def lexicon(lines: Iterable[str]) -> dict[str, str]:
    """Lines of marked words, or word and marked word with a tab; '#' comments; the last wins."""
    out = {}
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            word, _, marked = line.partition("\t")
            word, marked = word.strip(), (marked if "\t" in line else word).strip()
            if word and MARK in marked:
                out[key(word)] = marked
    return out


def _as_written(word: str, marked: str) -> str:
    plain = word.replace(MARK, "")
    if plain.isupper():
        return marked.upper()
    if plain[:1].isupper() and plain[1:].islower():
        return marked[:1].upper() + marked[1:]
    return marked


def mark_words(text: str | None, words: dict[str, str], dictionary: Callable[[str], str] | None = None, force: bool = False) -> str | None:
    """Marked forms for the words of a text; texts with marks stay, unless forced."""
    if not text or (MARK in text and not force):
        return text

    def one(m: re.Match) -> str:
        hit = words.get(key(m[0]))
        return _as_written(m[0], hit) if hit else dictionary(m[0]) if dictionary else m[0]

    return WORD.sub(one, text)


def repair(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repair_apostrophes, na_action="ignore")

    return run(c)


def mark(c: Column, words: dict[str, str]) -> Column:
    """Lexicon marks in Arrow batches. The lexicon is a file of hand-made entries, small by nature."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: mark_words(t, words), na_action="ignore")

    return run(c)


def prepare(text: str | None, language: str | None, words: dict[str, str]) -> str:
    """Numerals in words, then stress marks."""
    from .numbers import expand, is_ukrainian

    text = (text or "").strip()
    return mark_words(expand(text) if is_ukrainian(language) else text, words) or ""
