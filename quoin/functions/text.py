"""Label and string functions as Column expressions."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what the label alphabet has for them, one by one.
TYPOGRAPHIC = "–“”„‟‘’‚‛"
PLAIN = "—\"\"\"\"''''"
# Characters that text layers use for a soft hyphen.
SOFT_HYPHENS = "\x02\ufffe\u00ad"
# LaTeX macros and their characters.
LATEX = {
    r"\times": "×", r"\div": "÷", r"\pm": "±", r"\mp": "∓", r"\leq": "≤", r"\geq": "≥", r"\neq": "≠", r"\approx": "≈", r"\infty": "∞", r"\rightarrow": "→",
    r"\leftarrow": "←", r"\Rightarrow": "⇒", r"\deg": "°", r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\pi": "π", r"\mu": "μ", r"\Omega": "Ω",
}
#: What str.strip() takes off and str.split() splits at, as far as it occurs in text.
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"
BLANKS = r"[ \t\n\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{2028}\x{2029}]+"
#: Where str.splitlines() splits.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(text: Column, chars: str = BLANK) -> Column:
    return F.btrim(text, F.lit(chars))


def normalize_label(text: Column) -> Column:
    return F.translate(text, TYPOGRAPHIC, PLAIN)


def restore_hyphens(text: Column) -> Column:
    return F.translate(text, SOFT_HYPHENS, "---")


def _class(alphabet: list[str]) -> str:
    """The alphabet and the space, as the inside of a character class."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in sorted({*alphabet, " "}))


def out_of_alphabet(text: Column, alphabet: list[str]) -> Column:
    """Characters that the alphabet lacks, each once, in the order of their first appearance."""
    strange = F.regexp_replace(text, f"[{_class(alphabet)}]+", "")
    return F.when(strange == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(F.split(strange, "")), lambda c: c != ""))


def finalize(bucket: Column, text: Column, normalize: bool, alphabet: list[str] | None) -> tuple[Column, Column]:
    """(bucket, label): normalised first; a good line with characters outside the alphabet needs review."""
    label = normalize_label(text) if normalize else text
    if alphabet is not None:
        bucket = F.when((bucket == "good") & label.rlike(f"[^{_class(alphabet)}]"), "needs_review").otherwise(bucket)
    return bucket, label


def postprocess(text: Column) -> Column:
    """Model answer without code fence, LaTeX macros as characters, single spaces; null as empty."""
    out = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\A```[a-zA-Z]*\n?", "")
    out = strip(F.regexp_replace(out, r"\n?```\n?\z", ""))
    macros = sorted(LATEX, key=lambda m: (-len(m), m))
    plain = reduce(lambda c, m: F.regexp_replace(c, "\\" + m + "(?![a-zA-Z])", LATEX[m]), macros, out)
    out = F.when(F.contains(out, F.lit("\\")), plain).otherwise(out)
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def region_lines(text: Column) -> Column:
    """Non-blank lines of a model's answer for one region."""
    return F.filter(F.transform(F.split(postprocess(text), LINE_ENDS), lambda x: strip(x)), lambda x: x != "")


#: A reference to a character, by number or by name; the last semicolon may be missing.
ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers that stand for another character than their own: those of the old Windows code page, NUL and CR.
RENUMBERED = {n: bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
#: Names that count without a semicolon too, also as the beginning of a longer word.
BARE_NAMES = {k: v for k, v in html5.items() if not k.endswith(";")}


def _table(names: dict) -> Column:
    """A dictionary as one map literal."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _named(names: dict, name: Column) -> Column:
    """The entry of a large dictionary, or null. Maps are searched from the front, so there is one for each first letter."""
    by_letter: dict[str, dict] = {}
    for k, v in names.items():
        by_letter.setdefault(k[0], {})[k] = v
    table = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")
    return F.element_at(F.element_at(table, F.substring(name, 1, 1)), name)


def _numbered(n: Column) -> Column:
    """The character of a number, as browsers read it; nothing for those that are no characters."""
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    renamed = F.element_at(_table({str(k): v for k, v in RENUMBERED.items()}), n.cast("string"))
    wrong = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(wrong, "\ufffd").when(renamed.isNotNull(), renamed).when(none, "").otherwise(own)


def _resolved(name: Column) -> Column:
    """What stands for the entity `&name`."""
    digits = F.regexp_extract(name, "^#([0-9]+)", 1)
    hexed = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1)
    big = lambda d, most: F.length(F.ltrim(d, F.lit("0"))) > most
    number = F.when(digits != "", F.when(~big(digits, 8), digits.try_cast("long"))).otherwise(F.when(~big(hexed, 7), F.conv(hexed, 16, 10).try_cast("long")))
    longest = max(map(len, BARE_NAMES))
    begun = F.coalesce(*[F.concat(_named(BARE_NAMES, F.substring(name, 1, k)), F.substring(name, k + 1, 40)) for k in range(longest, 1, -1)])
    named = F.coalesce(_named(html5, name), begun, F.concat(F.lit("&"), name))
    return F.when(name.startswith("#"), _numbered(number)).otherwise(named)


def unescape(text: Column) -> Column:
    """All HTML character references resolved, by name (the table of HTML5) and by number."""
    between = F.split(text, ENTITY)
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), _resolved)
    joined = F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.coalesce(e, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, BLANKS, " "))


def strip_html(value: Column) -> Column:
    """Tags as spaces, entities resolved, white space squeezed; null as empty."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", " ")))


def safe_filename(title: Column, sha1: Column, ext: Column, max_len: int = 100) -> Column:
    """First eight digits of the hash, and the title without namespace, extension and characters that file systems refuse."""
    stem = F.regexp_replace(title, r"(?s)\A[^:]*:", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"(?s)\.[^.]*\z", ""), r'[<>:"/\\|?*\x00-\x1F]', "_")
    stem = F.btrim(F.regexp_replace(stem, BLANKS, "_"), F.lit("._"))
    stem = F.when(stem == "", "file").otherwise(F.substring(stem, 1, max_len))
    return F.concat(F.substring(sha1, 1, 8), F.lit("_"), stem, ext)


SIZE = r"(?s)\A(.*)\t([0-9]+)\t([0-9]+)\n?\z"


def split_crop_size(annotation: Column) -> Column:
    """struct(text, w, h): w and h are null unless the text ends in tab, width, tab, height."""
    has = annotation.rlike(SIZE)
    part = lambda k: F.regexp_extract(annotation, SIZE, k)
    return F.struct(
        F.when(has, part(1)).otherwise(annotation).alias("text"), F.when(has, part(2).try_cast("int")).alias("w"), F.when(has, part(3).try_cast("int")).alias("h")
    )


def format_line(path: Column, text: Column, w: Column, h: Column) -> Column:
    """path, text and, if known, width and height, tab-separated; nothing is escaped."""
    base = F.concat(path, F.lit("\t"), text)
    return F.when(w.isNull() | h.isNull(), base).otherwise(F.concat_ws("\t", base, w, h))


def image_name(line: Column) -> Column:
    return F.regexp_extract(strip(F.split(line, "\t", 2)[0]), r"[^/]*\z", 0)


def clean_edit(text: Column) -> Column:
    return strip(F.translate(text, "\n\r", "  "))


def category_title(name: Column) -> Column:
    bare = F.translate(strip(name), "_", " ")
    return F.when(bare.startswith("Category:"), bare).otherwise(F.concat(F.lit("Category:"), bare))
