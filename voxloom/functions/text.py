"""Text functions as native column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space and word characters, in Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"\p{L}\p{N}_"
#: Characters that clean text keeps, besides words and spaces (fixed values).
KEPT = r"\u0400-\u04FF.,!?;:\-—'\"()«»"
STRESS = "́"


def strip(c: Column) -> Column:
    """Python's strip(): all white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def first_text(*cols: Column) -> Column:
    """The first of the columns that is not blank, stripped."""
    return F.coalesce(*map(blank_to_null, cols))


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def clean_text(c: Column) -> Column:
    """Collapse white space, turn three dots into one, drop characters outside the kept class.

    Combining stress marks are dropped too, so cleaning comes before marking.
    """
    c = F.regexp_replace(strip(c), rf"{SPACE}+", " ")
    c = F.replace(c, F.lit("..."), F.lit("."))
    return strip(F.regexp_replace(c, rf"[^{WORD}\s\x1c-\x1f\x85\p{{Z}}{KEPT}]", ""))


def clean_field(c: Column) -> Column:
    """clean_text for pipe-delimited files: pipes become spaces first."""
    return clean_text(F.replace(c, F.lit("|"), F.lit(" ")))


def strip_nonspeech(c: Column) -> Column:
    """Drop *actions* and [notes], collapse the spaces."""
    c = F.regexp_replace(F.regexp_replace(c, r"\*[^*]+\*", " "), r"\[[^\[\]]*\]", " ")
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def count_syllables(c: Column) -> Column:
    """Ukrainian vowel letters plus groups of Latin vowels; 0 for null."""
    n = F.regexp_count(c, F.lit("[аеєиіїоуюяАЕЄИІЇОУЮЯ]")) + F.regexp_count(c, F.lit("[aeiouyAEIOUY]+"))
    return F.coalesce(n, F.lit(0))


def word_script(c: Column) -> Column:
    """'uk' for words of mostly Cyrillic letters (ties too), 'en' for Latin, null for neither."""
    cyrillic = F.regexp_count(c, F.lit(r"[Ѐ-ӿ]"))
    latin = F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when((cyrillic == 0) & (latin == 0), F.lit(None).cast("string")).when(cyrillic >= latin, "uk").otherwise("en")


def assign_clip_language(text: Column, tag: Column) -> Column:
    """Latin text is en; in Cyrillic text, letters of one language decide, ru before uk, then the tag."""
    script, tag = word_script(text), blank_to_null(F.lower(tag))
    known = F.when(tag.isin("ru", "uk"), tag).otherwise("uk")
    cyrillic = F.when(text.rlike("[ыэёъЫЭЁЪ]"), "ru").when(text.rlike("[ґєіїҐЄІЇ]"), "uk").otherwise(known)
    return F.when(script == "en", "en").when(script == "uk", cyrillic).otherwise(tag)


def sanitize_token(c: Column) -> Column:
    """A name of ASCII letters, digits, dash and underscore."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+$", "")
    return or_default(s, "speaker")


def _named(c: Column, default: str) -> Column:
    return F.when(blank_to_null(c).isNull(), default).otherwise(sanitize_token(c))


def local_speaker(base: Column, video: Column, diarised: Column) -> Column:
    """base__video__speaker, or base__video where no speaker was told apart."""
    head = F.concat(_named(base, "speaker"), F.lit("__"), _named(video, "video"))
    return F.when(blank_to_null(diarised).isNull(), head).otherwise(F.concat(head, F.lit("__"), sanitize_token(diarised)))


def global_speaker(base: Column, k: Column) -> Column:
    return F.concat(_named(base, "speaker"), F.lit("_s"), k.cast("string"))


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters as one dash; an empty result is an error."""
    s = F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"[^a-zA-Z0-9_-]+", "-"), r"^-+|-+$", ""))
    return F.when(s != "", s).otherwise(F.raise_error(F.concat(F.lit("no letter or digit in: "), c)).cast("string"))


SOURCE = r"^([^:@=]*[^:@=\s][^:@=]*)(?::([^@=]*))?(?:@([^=]*))?=([^#]*[a-zA-Z0-9_][^#]*)(?:#.*)?$"


def parse_source(c: Column) -> Column:
    """repo[:config][@split]=speaker[#ignored] as a struct; null if malformed."""
    part = lambda k: F.regexp_extract(c, SOURCE, k)
    speaker = F.lower(F.regexp_replace(F.regexp_replace(strip(part(4)), r"[^a-zA-Z0-9_-]+", "-"), r"^-+|-+$", ""))
    parsed = F.struct(strip(part(1)).alias("repo_id"), blank_to_null(part(2)).alias("config"), or_default(part(3), "train").alias("split"), speaker.alias("speaker"))
    return F.when(c.rlike(SOURCE), parsed)


def filename_safe(c: Column) -> Column:
    return F.translate(c, "/\\", "__")


def halves(c: Column) -> Column:
    """The words of a text in two halves, the first of n // 2 words; (text, '') for one word."""
    w = F.split(strip(c), rf"{SPACE}+")
    n = F.size(w)
    k = F.floor(n / 2).cast("int")
    part = lambda a, m: F.array_join(F.slice(w, a, m), " ")
    return F.when(n >= 2, F.array(part(F.lit(1), k), part(k + 1, n - k))).otherwise(F.array(c, F.lit("")))


def has_stress(c: Column) -> Column:
    return c.contains(STRESS)


def strip_stress(c: Column) -> Column:
    return F.replace(c, F.lit(STRESS), F.lit(""))


def is_true(c: Column) -> Column:
    """A flag as text: 1, true, yes and on are true."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "on"), F.lit(False))


def split_list(c: Column, allowed: list[str]) -> Column:
    """A comma list, trimmed, without blanks; an item that is not allowed is an error."""
    items = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    bad = F.array_except(items, F.array(*map(F.lit, allowed)))
    return F.when(F.size(bad) == 0, items).otherwise(F.raise_error(F.concat(F.lit("unknown: "), F.array_join(bad, ", "))).cast("array<string>"))


def stage_ids(c: Column, marker: str = "stage") -> Column:
    """The numbers after a marker, distinct, ascending."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"{marker}[-_ ]?(?:id)?[=: ]*(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def rename_prefix(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Replace the first prefix that matches; a key that no rule covers is an error."""
    out = None
    for old, new in rules:
        changed = F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))
        out = F.when(c.startswith(old), changed) if out is None else out.when(c.startswith(old), changed)
    return out.otherwise(F.raise_error(F.concat(F.lit("no rule for: "), c)))


def decode_audio(c: Column, most: int) -> Column:
    """Base64 to bytes; null unless it decodes to between 1 and ``most`` bytes."""
    raw = F.try_to_binary(c, F.lit("base64"))
    return F.when(F.octet_length(raw).between(1, most), raw)


def reference_text(texts: Column) -> Column:
    """Reference texts with speaker tags, one a line; a single one stays as it is."""
    tagged = F.transform(texts, lambda t, i: F.concat(F.lit("<|speaker:"), i.cast("string"), F.lit("|>"), t))
    return F.when(F.size(texts) > 1, F.array_join(tagged, "\n")).otherwise(F.element_at(texts, 1))


def natural_rank(c: Column) -> Column:
    """Names order by the number of their digits, those without last, then by text."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.struct(F.when(digits != "", digits.cast("long")).otherwise(F.lit(10**9)).alias("n"), c.alias("name"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for nulls, unequal lengths and zero vectors."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda x: F.sqrt(F.aggregate(F.transform(d(x), lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
    scale = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (scale > 0), dot / scale), F.lit(0.0))


def synthesis_prompt(reference: Column, target: Column, prefix: str) -> Column:
    """The text of a training prompt; what the assistant says follows it."""
    turn = lambda who, *parts: F.concat(F.lit(f"<|im_start|>{who}\n"), *parts, F.lit("<|im_end|>\n"))
    return F.concat(turn("system", F.lit(prefix), F.lit("<|speaker:0|>"), reference), turn("user", target), F.lit("<|im_start|>assistant\n"))


#: Beginnings of tensor names and how their groups are called.
MODULES = {
    "text_model.": "text_model (slow AR)", "audio_decoder.layers.": "audio_decoder.layers (fast AR)", "audio_decoder.embeddings.": "audio_decoder.embeddings",
    "audio_decoder.output.": "audio_decoder.output", "audio_decoder.norm.": "audio_decoder.norm", "audio_decoder.codebook_embeddings.": "audio_decoder.codebook",
}


def module_group(key: Column) -> Column:
    """The group of a tensor by the beginning of its name."""
    return F.coalesce(*(F.when(key.startswith(k), v) for k, v in MODULES.items()), F.lit("other"))
