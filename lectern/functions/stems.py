"""English words for search: without stop words, cut to their stems, all as column expressions.

A stem is reached by suffix rules in order, each a pattern and what replaces it: plurals, ``-ed`` and ``-ing`` (with the
ending mended: ``hop~`` from hopping and hoping), ``-y``, then longer suffixes after a stem with a vowel and a consonant
(one measure) or two. They follow the well-known suffix-stripping steps; stems are not bit-equal to any one
library's. Words of other letters than a to z, and of fewer than three, stand as they are.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.values import STOP_WORDS

_V, _C = "[aeiouy]", "[^aeiouy]"
_ONE = f"[a-z]*{_V}{_C}[a-z]*?"
_TWO = f"[a-z]*{_V}+{_C}+{_V}+{_C}[a-z]*?"


def _longer(suffixes: dict[str, str], stem: str) -> list[tuple[str, str]]:
    return [(f"^({stem}){suffix}$", f"$1{new}") for suffix, new in suffixes.items()]


#: Suffixes and what takes their place, after one measure and after two.
_AFTER_ONE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_AFTER_TWO = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

#: (pattern, replacement), in order; ``~`` marks where -ed or -ing went until the ending is mended.
RULES: list[tuple[str, str]] = [
    ("sses$", "ss"), ("ies$", "i"), ("([^su])s$", "$1"),
    (f"^({_ONE})eed$", "$1ee"), (f"^([a-z]*{_V}[a-z]*)(?:ed|ing)$", "$1~"), ("^([a-z]*)ee~$", "$1ee"),
    ("(at|bl|iz)~$", "$1e"), *((f"{c}{c}~$", c) for c in "bdfgmnprt"), (f"^({_C}*{_V}[^aeiouywx])~$", "$1e"), ("~$", ""),
    (f"^([a-z]*{_V}[a-z]*{_C})y$", "$1i"),
    *_longer(_AFTER_ONE, _ONE), *_longer(dict.fromkeys(_AFTER_TWO, ""), _TWO), (f"^({_TWO}[st])ion$", "$1"),
    (f"^({_TWO})e$", "$1"), (f"^({_C}*{_V}{{2,}}{_C}+)e$", "$1"), (f"^([a-z]*{_V}+{_C}+{_V}+l)l$", "$1"),
]
_STEMMED = "^[a-z]{3,}$"


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    cut = reduce(lambda w, rule: F.regexp_replace(w, rule[0], rule[1]), RULES, word)
    return F.when(word.rlike(_STEMMED), cut).otherwise(word)


def stem_sql(word: str) -> str:
    """The same as ``stem`` in DuckDB's SQL."""
    cut = reduce(lambda w, rule: f"regexp_replace({w}, '{rule[0]}', '{rule[1].replace('$', chr(92))}')", RULES, word)
    return f"CASE WHEN regexp_matches({word}, '{_STEMMED}') THEN {cut} ELSE {word} END"


def _tail(pattern: str) -> str:
    """The letters that a rule's pattern ends with."""
    return re.search(r"([a-z~]*)\$$", pattern)[1]


_COMPILED = [(_tail(rule), re.compile(rule), new.replace("$", "\\")) for rule, new in RULES]


def stem_of(word: str) -> str:
    """The same as ``stem`` for one word."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    for tail, rule, new in _COMPILED:
        if word.endswith(tail):
            word = rule.sub(new, word)
    return word


def is_stop_word(word: Column) -> Column:
    """Whether a lower-case word is too common to be searched for."""
    return word.isin(*STOP_WORDS)


def stop_words_sql() -> str:
    return "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def placed_words(text: Column) -> Column:
    """The lower-case words of letters and digits of a text, in order; a word's place is its index."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
