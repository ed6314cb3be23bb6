"""Plausibility of words from an embedded text layer, by their shape alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.text import SOFT_HYPHENS

# Letter ranges, vowels, look-alikes and punctuation.
CYRILLIC, LATIN = "а-яёА-ЯЁ", "A-Za-zÀ-ÖØ-öø-ÿ"
VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ"
LOOK_ALIKES = "ABCEHKMOPTXaceopxy"
PUNCTUATION = "«»„“”\"'()[]{}.,;:!?—–-№%°*+=<>/©"
# Shapes of a clean word: Cyrillic with hyphens, units and their quotients, abbreviations, Latin, numbers, Roman numbers.
UNIT = "[а-яё]{1,4}[0-9]?"
CLEAN_WORD = "|".join([
    f"[{CYRILLIC}]+(-[{CYRILLIC}]+)*", f"{UNIT}(/{UNIT})+", "[а-яё]{1,3}[0-9]", r"[а-яё]{1,4}(\.[а-яё]{1,4})+",
    f"[{LATIN}]+('[{LATIN}]+)?(-[{LATIN}]+)*", "[0-9]+([.,:/-][0-9]+)*", "[IVXL]+",
])
MAX_ACRONYM = 5
MIN_SPACED_RUN = 3
MIN_PAGE_WORDS = 5
PAGE_MIN_QUALITY = 0.98


def word_core(word: Column) -> Column:
    return F.btrim(F.translate(word, SOFT_HYPHENS, ""), F.lit(PUNCTUATION))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def word_ok(word: Column, cyrillic_text: Column) -> Column:
    return core_ok(word_core(word), cyrillic_text)


def core_ok(core: Column, cyrillic_text: Column) -> Column:
    """word_ok of a word without soft hyphens and outer punctuation."""
    acronym = is_upper(core) & (F.length(core) <= MAX_ACRONYM)
    mute = (F.length(core) >= 4) & core.rlike(f"^[{CYRILLIC}]+$") & ~acronym & ~core.rlike(f"[{VOWELS}]")
    foreign = cyrillic_text & core.rlike(f"[{LATIN}]")
    capitals = is_upper(core) & (F.length(core) >= 2) & ~core.rlike(f"^[{LOOK_ALIKES}]+$")
    return F.when(core == "", True).when(~core.rlike(f"^({CLEAN_WORD})$") | mute, False).when(foreign, capitals).otherwise(True)


def single_letter(word: Column) -> Column:
    return is_letter(word_core(word))


def is_letter(core: Column) -> Column:
    return (F.length(core) == 1) & core.rlike(r"^\p{L}$")


def letter_balance(word: Column) -> Column:
    """Cyrillic minus Latin letters."""
    return F.regexp_count(word, F.lit(f"[{CYRILLIC}]")) - F.regexp_count(word, F.lit(f"[{LATIN}]"))
