"""Scalar functions on texts and times, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"<\|(?:speaker\d+|nospeech|endoftext|\d+(?:\.\d+)?)\|>"
#: Unicode white space at either end.
_ENDS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def words_of(text: Column) -> Column:
    """Words between Unicode white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def has_word_character(text: Column) -> Column:
    return text.rlike(r"(?U)\w")


def is_silent(decoded: Column) -> Column:
    """Declared silence, or nothing but control tokens."""
    return decoded.contains("<|nospeech|>") | (strip(F.regexp_replace(decoded, TAG, "")) == "")


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm; seconds are rounded within the minute, without carrying."""
    whole = F.floor(seconds / 3600)
    return F.format_string("%02d:%02d:%06.3f", whole, F.floor((seconds - whole * 3600) / 60), seconds - F.floor(seconds / 60) * 60)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm from whole milliseconds, never negative."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    part = lambda size, of: F.floor(ms / size) % of
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def escape_vtt(text: Column) -> Column:
    for raw, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(put))
    return text


def escape_srt(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def speaker_name(gid: Column) -> Column:
    return F.format_string("SPEAKER_%02d", gid)


def unpad(seconds: Column, pad: float) -> Column:
    """Back to the timeline without the pad in front; clamped at the start."""
    return F.round(F.greatest(F.lit(0.0), seconds - F.lit(float(pad))), 2) if pad > 0 else seconds


def timestamp_text(token: Column, offset: Column, first: int, step: float) -> Column:
    return F.format_string("<|%.2f|>", (token - first) * F.lit(step) + offset)


def word_key(text: Column) -> Column:
    """Capital letters and apostrophes of a word."""
    return F.regexp_replace(F.upper(text), "[^A-Z']", "")


def plain_apostrophes(text: Column) -> Column:
    return F.translate(text, "’‘ʼ`´", "'''''")


def join_acronyms(text: Column) -> Column:
    """Spelled letters with underscores become one word: ``L_C_D_`` is ``LCD``.

    A spelling is a whole word of single capitals with underscores between, perhaps an ``s`` and an
    underscore at its end, of any length.  The text is cut at its spellings, which lose their
    underscores and are put back; texts without an underscore are left alone.
    """
    spelled = r"(?U)\b[A-Z](?:_[A-Z])+s?_?\b"
    found = F.transform(F.regexp_extract_all(text, F.lit(spelled), F.lit(0)), lambda x: F.translate(x, "_", ""))
    between = F.split(text, spelled, -1)
    inner = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    inner = F.regexp_replace(inner, r"(?U)\b([A-Z])_(?=[A-Za-z])", "$1")
    inner = F.regexp_replace(inner, r"(?U)\b([A-Z])_(?=\W|$)", "$1")
    return F.when(F.contains(text, F.lit("_")), inner).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Transcript markup: spelled letters, bracketed notes, lone symbols, space before punctuation."""
    text = F.regexp_replace(join_acronyms(text), r"\[[^\]]+\]", " ")
    text = F.regexp_replace(text, r"(?U)(?<!\S)[$%#@]+(?!\S)", " ")
    text = F.regexp_replace(text, r"(?U)\s+([.,!?;:])", "$1")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def currency_words(text: Column) -> Column:
    """Cents written behind an amount join it; amounts below one become cents; ``1`` stays a digit."""
    text = F.regexp_replace(text, r"([€£$])([0-9]+) (?:and )?¢([0-9])\b", "$1$2.0$3")
    text = F.regexp_replace(text, r"([€£$])([0-9]+) (?:and )?¢([0-9]{2})\b", "$1$2.$3")
    return F.regexp_replace(text, r"[€£$]0.0?([0-9]{1,2})\b", "¢$1")


def normalize_spoken(text: Column, *, numbers=currency_words, spelling=lambda t: t) -> Column:  # noqa: ANN001
    """Fold what differs in writing only: case, hyphens, brackets, punctuation, diacritics.

    Number words and spellings need tables; ``numbers`` and ``spelling`` take a column and return
    one, so a table-driven expression can be put in.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?U)\b([a-z])-([a-z]+)\b", "$1$2")
    t = F.regexp_replace(plain_apostrophes(t), r"(?U)(\d)'s\b", "$1s")
    t = F.regexp_replace(F.regexp_replace(t, r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+'", "'"), r"(?U)(\d),(\d)", "$1$2")
    t = F.regexp_replace(t, r"\.([^0-9]|$)", " $1")
    t = spelling(numbers(_plain_letters(t)))
    t = F.regexp_replace(t, r"(?U)\bokay\b", "ok")
    t = F.regexp_replace(F.regexp_replace(t, r"[.$¢€£]([^0-9])", " $1"), r"([^0-9])%", "$1 ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


#: Letters that decomposition leaves whole.  Fixed values.
WHOLE_LETTERS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
#: Letters with a mark, by base letter, lower case.  Fixed values.
MARKED_LETTERS = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}


def _plain_letters(text: Column) -> Column:
    """Marks off letters; symbols and punctuation but ``.%$¢€£'`` become spaces."""
    for raw, put in WHOLE_LETTERS.items():
        text = F.replace(text, F.lit(raw), F.lit(put))
    text = F.translate(text, "".join(MARKED_LETTERS.values()), "".join(k * len(v) for k, v in MARKED_LETTERS.items()))
    return F.regexp_replace(F.regexp_replace(text, r"\p{Mn}+", ""), r"[\p{M}\p{S}\p{P}&&[^.%$¢€£']]", " ")


#: Languages of the public speech models by code.  Fixed values; :func:`language_code` takes any other table.
LANGUAGES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian", "ko": "korean", "fr": "french", "ja": "japanese", "pt": "portuguese", "tr": "turkish",
    "pl": "polish", "ca": "catalan", "nl": "dutch", "ar": "arabic", "sv": "swedish", "it": "italian", "id": "indonesian", "hi": "hindi", "fi": "finnish", "vi": "vietnamese",
    "he": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay", "cs": "czech", "ro": "romanian", "da": "danish", "hu": "hungarian", "ta": "tamil", "no": "norwegian",
    "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian", "la": "latin", "mi": "maori", "ml": "malayalam", "cy": "welsh", "sk": "slovak",
    "te": "telugu", "fa": "persian", "lv": "latvian", "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian", "kn": "kannada", "et": "estonian", "mk": "macedonian",
    "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian", "ne": "nepali", "mn": "mongolian", "bs": "bosnian", "kk": "kazakh", "sq": "albanian", "sw": "swahili",
    "gl": "galician", "mr": "marathi", "pa": "punjabi", "si": "sinhala", "km": "khmer", "sn": "shona", "yo": "yoruba", "so": "somali", "af": "afrikaans", "oc": "occitan",
    "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi", "gu": "gujarati", "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese",
    "ht": "haitian creole", "ps": "pashto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese", "sa": "sanskrit", "lb": "luxembourgish", "my": "myanmar", "bo": "tibetan", "tl": "tagalog",
    "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian", "ln": "lingala", "ha": "hausa", "ba": "bashkir", "jw": "javanese", "su": "sundanese", "yue": "cantonese",
}
#: Further names.  Fixed values.
LANGUAGE_NAMES = {
    "burmese": "my", "valencian": "ca", "flemish": "nl", "haitian": "ht", "letzeburgesch": "lb", "pushto": "ps", "panjabi": "pa", "moldavian": "ro", "moldovan": "ro", "sinhalese": "si",
    "castilian": "es", "mandarin": "zh",
}


def language_code(value: Column, table: dict[str, str] = LANGUAGES, names: dict[str, str] = LANGUAGE_NAMES) -> Column:
    """Null for blank or ``auto``; else the code for a code or name; an unknown one is an error."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    codes = {c: c for c in table} | {name: c for c, name in table.items()} | {name: c for name, c in names.items() if c in table}
    known = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.when(raw.isin("", "auto"), F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(known, raw), F.raise_error(F.concat(F.lit("unsupported language: "), raw)).cast("string")))


def effective_language(explicit: Column, detected: Column) -> Column:
    return F.coalesce(explicit, detected)
