"""Text functions on columns: paragraphs, words, headings, noise, language, sentences, clean-up.

One class of white space is used throughout (``SPACE``: the Unicode property), whatever an engine's
own ``\\s`` covers. All functions return null for null.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.values import CAPITALS_BYTES, CODE_LANGUAGES, HEADING_BYTES, HEADING_WORDS, MONO_FONTS

SPACE = r"\t-\r \x{85}\p{Z}"
_TRIM = rf"\A[{SPACE}]+|[{SPACE}]+\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+"))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end does not start another line."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def paragraphs(text: Column) -> Column:
    """Trimmed, non-empty pieces between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\n|\r\n\r\n"), strip), lambda p: p != "")


def heading(paragraph: Column) -> Column:
    """The heading that a paragraph's first line is, or null.

    A heading is short (in bytes) and is marked by ``#``, starts with a word like "chapter", or is in
    capitals with two words of two letters.
    """
    line = strip(F.substring_index(paragraph, "\n", 1))
    letters = F.regexp_replace(line, r"\P{L}", "")
    word_count = F.size(F.filter(words(line), lambda w: F.regexp_count(w, F.lit(r"\p{L}")) >= 2))
    capitals = (letters != "") & ~letters.rlike(r"\P{Lu}") & (word_count >= 2) & (F.octet_length(line) < CAPITALS_BYTES)
    named = reduce(or_, [F.lower(line).startswith(w) for w in HEADING_WORDS])
    marked = strip(F.regexp_replace(line, r"\A#+", ""))
    return F.when((line == "") | (F.octet_length(line) > HEADING_BYTES), F.lit(None)).when(line.startswith("#"), marked).when(named | capitals, line)


def is_layout_noise(text: Column) -> Column:
    """Columns, tables and labels rather than prose: many wide gaps, or mostly lines of up to three words."""
    n = count_words(text)
    wide = F.regexp_count(text, F.lit("(?=   )"))
    own = F.filter(lines(text), lambda x: strip(x) != "")
    short = F.size(F.filter(own, lambda x: count_words(x) <= 3)) / F.greatest(F.size(own), F.lit(1))
    return (n == 0) | ((wide / F.greatest(n, F.lit(1)) > 0.3) & (n < 120)) | ((short > 0.7) & (n < 80))


def language(text: Column) -> Column:
    """``sa`` if over 15 whole per cent of what is not white space is Devanagari, else ``en``."""
    total = F.regexp_count(text, F.lit(rf"[^{SPACE}]"))
    own = F.regexp_count(text, F.lit(r"[\x{900}-\x{97F}]"))
    return F.when(F.floor(own * 100 / F.greatest(total, F.lit(1))) > 15, "sa").when(text.isNotNull(), "en")


def sentences(text: Column) -> Column:
    """Trimmed pieces between end marks, one blank and a capital."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!]) (?=\p{Lu})"), strip), lambda s: s != "")


def without_page_numbers(page: Column) -> Column:
    """A page's text without a first and a last line that are only a number."""
    own = lines(page)
    bare = lambda x: strip(x).rlike(r"\A[0-9]+\z")
    first = F.when(bare(F.get(own, F.lit(0))), 1).otherwise(0)
    last = F.when((F.size(own) > first) & bare(F.get(own, F.size(own) - 1)), 1).otherwise(0)
    return F.array_join(F.slice(own, first + 1, F.greatest(F.size(own) - first - last, F.lit(0))), "\n")


def is_figure_noise(text: Column) -> Column:
    """Labels of a figure rather than prose."""
    n = count_words(text)
    own = F.filter(lines(text), lambda x: strip(x) != "")
    short = F.size(F.filter(own, lambda x: count_words(x) <= 3)) / F.greatest(F.size(own), F.lit(1))
    dense = F.octet_length(text) / F.greatest(n, F.lit(1))
    wide = F.regexp_count(text, F.lit("   ")) / F.greatest(n, F.lit(1))
    return (n == 0) | ((dense > 15) & (short > 0.5)) | ((short > 0.8) & (n < 80)) | ((wide > 0.3) & (n < 80))


def clean_page(page: Column) -> Column:
    """A page's prose; empty where it is noise or under ten words."""
    text = strip(without_page_numbers(page))
    return F.when((text == "") | is_figure_noise(text) | (count_words(text) < 10), "").otherwise(text)


def is_mono_font(family: Column) -> Column:
    """Whether a font's name (after a subset's prefix) is that of a monospaced one."""
    name = F.lower(strip(F.substring_index(family, "+", -1)))
    return reduce(or_, [F.contains(name, F.lit(x)) for x in MONO_FONTS])


def code_language(classes: Column) -> Column:
    """The programming language that CSS classes name, or null."""
    own = words(classes)
    prefixed = F.filter(F.transform(own, lambda t: F.regexp_extract(t, r"\A(?:language|lang|highlight)-(.+)\z", 1)), lambda t: t != "")
    pandoc = F.filter(own, lambda t: (t != "sourceCode") & t.rlike(r"\A[\p{L}\p{N}]*\z"))
    bare = F.filter(F.transform(own, F.lower), lambda t: t.isin(*CODE_LANGUAGES))
    return F.coalesce(F.lower(F.get(prefixed, F.lit(0))), F.when(F.contains(classes, F.lit("sourceCode")), F.lower(F.get(pandoc, F.lit(0)))), F.get(bare, F.lit(0)))


def without_fences(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(reply), r"\A```(?:json)?\s*\n?", ""), r"\n?```\s*\z", "")


def protected_escapes(reply: Column) -> Column:
    """A JSON reply whose backslashes are doubled, but for those of ``\\\\``, ``\\"``, ``\\/`` and ``\\uXXXX``: formulas survive parsing."""
    # Escapes that JSON knows are set aside whole; any other backslash is doubled.
    kept = F.regexp_replace(F.replace(reply, F.lit("\\\\"), F.lit("\x01\x01")), r'\\("|/|u[0-9a-fA-F]{4})', "\x01$1")
    return F.translate(F.replace(kept, F.lit("\\"), F.lit("\\\\")), "\x01", "\\")


def first_array(reply: Column) -> Column:
    """The text from the first ``[`` to the last ``]``, or null."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def listed(text: Column, separator: str = ";") -> Column:
    """Trimmed, non-empty items of a list in a text."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda x: x != "")


def clean_title(title: Column, default: str = "Untitled") -> Column:
    """A title on one line; ``default`` where nothing is left."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(title, r"[\r\n]+", " ")), F.lit("")), F.lit(default))


def shortened(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with an ellipsis where it was cut."""
    line = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def parsed_size(text: Column) -> Column:
    """Bytes of a size such as ``1.5M``; null where it is none."""
    number = F.regexp_extract(strip(text), r"(?i)\A([0-9.]+)\s*([KMG]?)B?\z", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(strip(text), r"(?i)\A([0-9.]+)\s*([KMG]?)B?\z", 2))
    return F.floor(number * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)).cast("bigint")


def shown_size(n_bytes: Column) -> Column:
    """Bytes as a short text with a unit."""
    unit = lambda power, name: F.concat(F.format_number(n_bytes / 1024**power, 1), F.lit(f" {name}"))
    return F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit(" B"))).when(n_bytes < 1024**2, unit(1, "KB")).when(n_bytes < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def content_name(content: Column) -> Column:
    """A short name that is the same for equal contents."""
    return F.substring(F.sha2(content, 256), 1, 16)


def tokens(*parts: Column) -> Column:
    """Distinct lower-case words of letters and digits of all parts, for search."""
    text = F.concat_ws(" ", *parts)
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def query_prefixes(query: str) -> list[str]:
    """The word prefixes that a search asks for, all of them."""
    cleaned = "".join(c if c.isalnum() else " " for c in query.lower())
    return cleaned.split()
