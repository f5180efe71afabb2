"""Ukrainian numerals in text as words: rules by priority, one Arrow-batched function.

Rules claim spans in the order of priority, a span never overlaps one claimed before, and
the claimed spans are then replaced from left to right. Spans whose number is out of a
rule's range stay as they are.
"""

from __future__ import annotations

import re
from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the language.
ONES = "нуль один два три чотири п'ять шість сім вісім дев'ять".split()
TEENS = "десять одинадцять дванадцять тринадцять чотирнадцять п'ятнадцять шістнадцять сімнадцять вісімнадцять дев'ятнадцять".split()
TENS = "- - двадцять тридцять сорок п'ятдесят шістдесят сімдесят вісімдесят дев'яносто".split()
HUNDREDS = "- сто двісті триста чотириста п'ятсот шістсот сімсот вісімсот дев'ятсот".split()
FEMININE = {1: "одна", 2: "дві"}
NEUTER = {1: "одне"}
GENITIVE_ONES = "нуля одного двох трьох чотирьох п'яти шести семи восьми дев'яти".split()
GENITIVE_TEENS = "десяти одинадцяти дванадцяти тринадцяти чотирнадцяти п'ятнадцяти шістнадцяти сімнадцяти вісімнадцяти дев'ятнадцяти".split()
GENITIVE_TENS = "- - двадцяти тридцяти сорока п'ятдесяти шістдесяти сімдесяти вісімдесяти дев'яноста".split()
GENITIVE_HUNDREDS = "- ста двохсот трьохсот чотирьохсот п'ятисот шестисот семисот восьмисот дев'ятисот".split()
#: Stems of ordinals: 1 to 19, then tens from 20, then hundreds.
ORDINAL_ONES = "- перш друг трет четверт п'ят шост сьом восьм дев'ят десят одинадцят дванадцят тринадцят чотирнадцят п'ятнадцят шістнадцят сімнадцят вісімнадцят дев'ятнадцят".split()
ORDINAL_TENS = "- - двадцят тридцят сороков п'ятдесят шістдесят сімдесят вісімдесят дев'яност".split()
ORDINAL_HUNDREDS = "- сот двохсот трьохсот чотирьохсот п'ятисот шестисот семисот восьмисот дев'ятисот".split()
#: Endings by gender and case; "трет" has soft ones.
HARD = {
    "masc": dict(nom="ий", nom_pl="і", gen="ого", loc="ому", instr="им", gen_pl="их"),
    "fem": dict(nom="а", nom_pl="і", gen="ої", loc="ій", instr="ою", gen_pl="их"),
    "neut": dict(nom="е", nom_pl="і", gen="ого", loc="ому", instr="им", gen_pl="их"),
}
SOFT = {
    "masc": dict(nom="ій", nom_pl="і", gen="ього", loc="ьому", instr="ім", gen_pl="іх"),
    "fem": dict(nom="я", nom_pl="і", gen="ьої", loc="ій", instr="ьою", gen_pl="іх"),
    "neut": dict(nom="є", nom_pl="і", gen="ього", loc="ьому", instr="ім", gen_pl="іх"),
}
THOUSANDS = ("тисяча", "тисячі", "тисяч")
MILLIONS = ("мільйон", "мільйони", "мільйонів")


def plural(n: int, forms: tuple[str, str, str]) -> str:
    """The form of a noun that a number asks for."""
    if n % 100 in range(11, 15):
        return forms[2]
    return forms[0] if n % 10 == 1 else forms[1] if n % 10 in (2, 3, 4) else forms[2]


def _below_thousand(n: int, ones: Callable[[int], str], teens: list[str], tens: list[str], hundreds: list[str]) -> list[str]:
    if not 0 <= n < 1000:
        raise ValueError(n)
    out = [hundreds[n // 100]] if n >= 100 else []
    rest = n % 100
    if rest >= 20:
        out.append(tens[rest // 10])
        rest %= 10
    elif rest >= 10:
        return [*out, teens[rest - 10]]
    return [*out, ones(rest)] if rest or not out else out


def _small(n: int, gender: str) -> list[str]:
    own = {"fem": FEMININE, "neut": NEUTER}.get(gender, {})
    return _below_thousand(n, lambda k: own.get(k, ONES[k]), TEENS, TENS, HUNDREDS)


def cardinal(n: int, gender: str = "masc") -> str:
    """Nominative. Millions take feminine numbers too: the rule data ask for it."""
    if n < 0:
        return "мінус " + cardinal(-n, gender)
    out: list[str] = []
    for scale, forms in ((1_000_000, MILLIONS), (1000, THOUSANDS)):
        if n >= scale:
            head, n = divmod(n, scale)
            out += [*_small(head, "fem"), plural(head, forms)]
            if not n:
                return " ".join(out)
    return " ".join(out + _small(n, gender))


def cardinal_genitive(n: int) -> str:
    """Genitive up to a million, nominative beyond."""
    if n < 0:
        return "мінус " + cardinal_genitive(-n)
    if n >= 1_000_000:
        return cardinal(n)
    words = lambda k: _below_thousand(k, GENITIVE_ONES.__getitem__, GENITIVE_TEENS, GENITIVE_TENS, GENITIVE_HUNDREDS)
    head, rest = divmod(n, 1000)
    out = [] if not head else ["тисячі"] if head == 1 else [*words(head), "тисяч"]
    return " ".join(out + (words(rest) if rest or not head else []))


def ordinal(n: int, gender: str = "masc", case: str = "nom") -> str:
    """Only the last word is an ordinal; round thousands stay cardinal, and 1000 has no number."""
    if n <= 0:
        return cardinal(n)
    ended = lambda stem: stem + (SOFT if stem == "трет" else HARD)[gender][case]
    thousands, rest = divmod(n, 1000)
    out = ["тисяча"] if thousands == 1 else [*_small(thousands, "fem"), plural(thousands, THOUSANDS)] if thousands else []
    hundreds, low = divmod(rest, 100)
    if hundreds:
        out.append(HUNDREDS[hundreds] if low else ended(ORDINAL_HUNDREDS[hundreds]))
    if low >= 20 and low % 10:
        out += [TENS[low // 10], ended(ORDINAL_ONES[low % 10])]
    elif low:
        out.append(ended(ORDINAL_ONES[low] if low < 20 else ORDINAL_TENS[low // 10]))
    return " ".join(out)


def decimal(whole: int, fraction: str) -> str:
    feminine = whole % 10 in (1, 2) and whole % 100 not in (11, 12)
    part = "ціла" if whole % 10 == 1 and whole % 100 != 11 else "цілих"
    return f"{cardinal(whole, 'fem' if feminine else 'masc')} {part} {cardinal(int(fraction))}"


def version(whole: int, fraction: str) -> str:
    return f"{cardinal(whole)} {cardinal(int(fraction))}"


def _number(raw: str, dot=decimal) -> str:
    """A whole number or one with a fraction; ``dot`` reads fractions after a dot."""
    for sep, read in ((",", decimal), (".", dot)):
        if sep in raw:
            whole, fraction = raw.split(sep, 1)
            return read(int(whole), fraction)
    return cardinal(int(raw))


def _in_place(m: re.Match, words: str) -> str:
    """The span with its first number replaced."""
    return re.sub(r"-?\d+(?:[.,]\d+)?", words, m[0], count=1)


def _date(m):
    return f"{ordinal(int(m['day']), 'neut')} {m['month']} {ordinal(int(m['num']), case='gen')} року"


def _year(m):
    found = re.search(r"(?:19|20)\d{2}|229\d", m[0])
    if not found:
        return m[0]
    year, before, after = int(found[0]), m[0][: found.start()], m[0][found.end() :]
    if re.match(r"(?i)-х\b", after):
        gen = ordinal(year, case="gen")
        return before + gen.removesuffix("ого") + "их" + after[2:]
    if re.match(r"(?i)-м[уы]\b", after) or re.search(r"\bроці\b", m[0].lower()):
        return before + ordinal(year, case="loc") + re.sub(r"(?i)^-м[уы]\b", "", after)
    return before + ordinal(year, case="gen" if re.search(r"\bрок", m[0].lower()) else "loc") + after


def _time(m):
    hour, minutes = int(m["hour"]), int(m["num"])
    hour = 12 if hour == 0 else hour if hour == 24 else hour % 24 or 24
    return f"{ordinal(hour, 'fem')} " + ("нуль " if minutes < 10 else "") + cardinal(minutes)


def _percent(m):
    words = _number(m["num"])
    return f"{words} відсотків" if "%" in m[0] else _in_place(m, words)


def _temperature(m):
    words = ("мінус " if m["num"].startswith("-") else "") + _number(m["num"].lstrip("-"))
    return f"{words} градусів" if "°" in m[0] and "градус" not in m[0].lower() else _in_place(m, words)


#: Written endings of ordinals, with gender and case.
ENDINGS = {
    "ого": ("masc", "gen"), "ому": ("masc", "loc"), "ими": ("masc", "instr"), "им": ("masc", "instr"), "ої": ("fem", "gen"), "ій": ("fem", "loc"),
    "го": ("masc", "gen"), "му": ("masc", "loc"), "м": ("masc", "instr"), "й": ("masc", "nom"), "ї": ("fem", "gen"), "ша": ("fem", "nom"), "га": ("fem", "nom"),
    "тя": ("fem", "nom"), "та": ("fem", "nom"), "ма": ("fem", "nom"), "я": ("fem", "nom"), "а": ("fem", "nom"), "і": ("masc", "nom_pl"), "ше": ("neut", "nom"),
    "ге": ("neut", "nom"), "тє": ("neut", "nom"), "те": ("neut", "nom"), "е": ("neut", "nom"), "х": ("masc", "gen_pl"),
}


def _ending(m):
    n, tail = int(m["num"]), m["suf"].casefold()
    if tail == "ти" or (tail == "х" and n <= 4):
        return cardinal_genitive(n)
    return ordinal(n, *ENDINGS.get(tail, ("masc", "nom")))


def _pair(joined: str):
    return lambda m: f"{cardinal(int(m['a']))} {joined} {cardinal(int(m['num']))}"


def _plain(m):
    return cardinal(int(m["num"]))


def _count(m):
    return _in_place(m, _plain(m))


def _unit(m):
    return _in_place(m, _number(m["num"], version))


def _dotted(m):
    return (decimal if m["sep"] == "," else version)(int(m["whole"]), m["num"])


#: The rules in the order of priority, as pattern and reading; None leaves the span.
RULES: list[tuple[str, str, Callable | None]] = [
    ("alnum_codename", r"(?i)\b(?P<num>[A-ZА-ЯІЇЄҐ]\d{1,3}(?:[-–—‑]\d{1,3})?|\d{1,3}[A-Za-z])\b", None),
    ("date_day_month_year", r"(?i)\b(?P<day>\d{1,2})\s+(?P<month>січня|лютого|березня|квітня|травня|червня|липня|серпня|вересня|жовтня|листопада|грудня)\s+(?P<num>(?:19|20)\d{2})(?:\s*року)?\b", _date),
    ("year_with_roku", r"(?i)(?:(?:(?:\bу|\bв)\s+(?:19|20)\d{2}(?:-м[уы])?(?:\s*рок(?:у|і|ом)?)?)|(?:(?:19|20)\d{2}\s*рок(?:у|і|ів|и|ом)?\b)|(?:(?:19|20)\d{2}-х\b)|(?:(?:19|20)\d{2}\s*р\.?\b))", _year),
    ("time_hhmm", r"\b(?P<hour>\d{1,2}):(?P<num>\d{2})\b", _time),
    ("radio_hour", r"(?i)\b(?P<num>\d{1,2})\s+година\b", lambda m: ordinal(int(m["num"]), "fem") + " година"),
    ("percent", r"(?i)(?P<num>\d+(?:[.,]\d+)?)\s*(?:%|відсотк(?:ів|и|а|у)?\b)", _percent),
    ("caps_amount", r"(?i)(?P<num>\d{1,6})\s*криш(?:ок|ки|ками|кам|ках|ка)?\b", _count),
    ("vault_id", r"(?i)\b(?:сховищ(?:е|а|у|ем|і)|vault)\s*[#№]?\s*(?P<num>\d{1,3})\b", _count),
    ("duration_unit", r"(?i)(?P<num>\d{1,4})\s*(?P<unit>хв\.?|хвилин(?:и|у|ами)?|сек(?:унд(?:и|у|ами)?)?|годин(?:и|у|ами)?|дн(?:і|ів|я)|день|тижн(?:і|ів|я)|рок(?:и|ів|у|ом)|місяц(?:і|ів|я|ь))\b", _unit),
    ("distance_unit", r"(?i)(?P<num>\d{1,5}(?:[.,]\d+)?)\s*(?P<unit>м\b|метр(?:и|ів|а)|км\b|кілометр(?:и|ів|а))\b", _unit),
    ("temperature", r"(?i)(?P<num>-?\d{1,3}(?:[.,]\d+)?)\s*(?:°|градус(?:и|ів|а)?)\b", _temperature),
    ("deal_split", r"(?i)\b(?P<a>\d{1,3})\s+на\s+(?P<num>\d{1,3})\b", _pair("на")),
    ("ratio_slash", r"\b(?P<a>\d{1,4})\s*/\s*(?P<num>\d{1,4})\b", _pair("на")),
    ("countdown", r"\b(?P<num>\d{1,2})\.\.\.", lambda m: _plain(m) + "..."),
    ("hash_id", r"[#№]\s*(?P<num>\d{1,6})\b", lambda m: "номер " + _plain(m)),
    ("hyphen_ordinal", r"(?i)\b(?P<num>\d{1,4})(?:[-–—‑])?(?P<suf>ого|ому|ими|им|ої|ій|го|му|ї|й|ша|га|тя|та|ма|ше|ге|тє|те|ти|я|е|а|і|х|м)\b", _ending),
    ("en_ordinal", r"(?i)\b(?P<num>\d{1,4})(?P<suf>st|nd|rd|th)\b", lambda m: ordinal(int(m["num"]))),
    ("numeric_range", r"\b(?P<a>\d{1,4})[-–—‑](?P<num>\d{1,4})\b", _pair("—")),
    ("decimal_or_version", r"\b(?P<whole>\d+)(?P<sep>[.,])(?P<num>\d+)\b", _dotted),
    ("year_bare_fallout", r"\b(?P<num>(?:19[1-9]\d|20(?:0[1-9]|[1-9]\d)\d|229\d))\b", lambda m: ordinal(int(m["num"]))),
    ("bare_thousands_plus", r"\b(?P<num>[1-9]\d{3,5})\b", _plain),
    ("bare_int", r"\b(?P<num>\d{1,3})\b", _plain),
]
_COMPILED = [(name, re.compile(p), f) for name, p, f in RULES]
_GROUPED = re.compile(r"(?<=\d)\s+(?=\d{3}\b)")


def spans(text: str | None) -> list[tuple[str, re.Match, Callable | None]]:
    """The claimed spans of a text, from left to right."""
    if not text or not any(c.isdigit() for c in text):
        return []
    taken = bytearray(len(text))
    found = []
    for name, pattern, read in _COMPILED:
        for m in pattern.finditer(text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                found.append((name, m, read))
    return sorted(found, key=lambda x: x[1].start())


def expand(text: str | None) -> str | None:
    """The text with its numerals in words."""
    if not text or not any(c.isdigit() for c in text):
        return text
    text = _GROUPED.sub("", text)
    out, at = [], 0
    for _, m, read in spans(text):
        try:
            words = read(m) if read else m[0]
        except (ValueError, KeyError, TypeError, IndexError):
            words = m[0]
        out += [text[at : m.start()], words]
        at = m.end()
    return "".join([*out, text[at:]])


def is_ukrainian(language: str | None) -> bool:
    """Whether numerals are expanded: for Ukrainian, and where no language is set."""
    name = (language or "").strip().lower()
    return not name or name.startswith("uk") or name in ("ua",)


def expand_numbers(c: Column) -> Column:
    """:func:`expand` in Arrow batches; rows without a digit do not pass through Python's rules."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(expand, na_action="ignore")

    return run(c)


def number_spans(c: Column) -> Column:
    """The claimed spans as an array of (rule, start, end, text), to be exploded."""

    @F.pandas_udf("array<struct<rule:string,start:int,end:int,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"rule": n, "start": m.start(), "end": m.end(), "text": m[0]} for n, m, _ in spans(t)])

    return run(c)
