"""Texts with formulas between ``$`` or ``$$``: escapes that a model wrote out, and commands that JSON took for escapes.

A text is split once into formulas and what lies between them, so each character is looked at in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.values import FORMULA_COMMANDS

_FORMULA = r"\$\$[\s\S]*?\$\$|\$(?:[^$\\]|\\.)*?\$"
#: A formula, or what no formula begins in; a lone ``$`` stands by itself.
PIECES = rf"(?:{_FORMULA})|[^$]+|\$"
_ESCAPED = {"b": "\b", "t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _pieces(text: Column, formula, other) -> Column:
    found = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    is_formula = lambda p: p.startswith("$") & p.endswith("$") & (F.length(p) > 1)
    return F.array_join(F.transform(found, lambda p: F.when(is_formula(p), formula(p)).otherwise(other(p))), "")


def _rest(letter: str) -> str:
    """What follows the letter in the commands that begin with it."""
    return "|".join(FORMULA_COMMANDS[letter])


def written_escapes(text: Column) -> Column:
    r"""A written ``\n`` or ``\t`` becomes the character it stands for; within formulas not where a command like ``\nu`` or ``\theta`` begins."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))

    def in_formula(p: Column) -> Column:
        for letter in "nt":
            p = F.regexp_replace(p, rf"\\{letter}(?!{_rest(letter)})", _ESCAPED[letter])
        return p

    return _pieces(text, in_formula, plain)


def restored_commands(text: Column) -> Column:
    r"""Control characters that JSON made of a formula's commands become the commands again: a tab before ``imes`` is ``\times``."""

    def in_formula(p: Column) -> Column:
        for letter, character in _ESCAPED.items():
            p = F.regexp_replace(p, rf"{character}(?={_rest(letter)})", rf"\\{letter}")
        return p

    return _pieces(text, in_formula, lambda p: p)
