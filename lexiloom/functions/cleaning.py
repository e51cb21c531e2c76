"""Cleaning of raw lines: entities, control characters, punctuation, blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.rules import Rule, apply

# The entities that are unescaped, in order, "&amp;" last.
ENTITIES: list[Rule] = [
    ("text", "&bar;", "|"),
    ("text", "&#124;", "|"),
    ("text", "&lt;", "<"),
    ("text", "&gt;", ">"),
    ("text", "&bra;", "["),
    ("text", "&ket;", "]"),
    ("text", "&quot;", '"'),
    ("text", "&apos;", "'"),
    ("text", "&#39;", "'"),
    ("text", "&#91;", "["),
    ("text", "&#93;", "]"),
    ("text", "&amp;", "&"),
]
LATIN_ENTITIES: list[Rule] = [("text", f"&#{code};", chr(code)) for code in range(224, 256)]
ROUNDS = 3

_NBSP = "\u00a0"
_SQUEEZE: Rule = ("regex", " +", " ")

# Punctuation rules, in order.
BRACKETS: list[Rule] = [
    ("text", "\r", ""),
    ("text", "(", " ("),
    ("text", ")", ") "),
    _SQUEEZE,
    ("regex", r"\) ([.!:?;,])", ")$1"),
    ("text", "( ", "("),
    ("text", " )", ")"),
    ("regex", r"([0-9]) %", "$1%"),
    ("text", " :", ":"),
    ("text", " ;", ";"),
]
BACKQUOTES: list[Rule] = [("text", "`", "'"), ("text", "''", ' " ')]
TYPOGRAPHIC: list[Rule] = [
    ("text", "„", '"'),
    ("text", "“", '"'),
    ("text", "”", '"'),
    ("text", "–", "-"),
    ("text", "—", " - "),
    _SQUEEZE,
    ("text", "´", "'"),
    ("regex", "([a-zA-Z])‘([a-zA-Z])", "$1'$2"),
    ("regex", "([a-zA-Z])’([a-zA-Z])", "$1'$2"),
    ("text", "‘", '"'),
    ("text", "‚", '"'),
    ("text", "’", '"'),
    ("text", "''", '"'),
    ("text", "´´", '"'),
    ("text", "…", "..."),
]
# The line-based rules tell a no-break space from a plain one; the column-based ones see plain ones only.
FRENCH_QUOTES: list[Rule] = [
    ("text", _NBSP + "«" + _NBSP, ' "'),
    ("text", "«" + _NBSP, '"'),
    ("text", "«", '"'),
    ("text", _NBSP + "»" + _NBSP, '" '),
    ("text", _NBSP + "»", '"'),
    ("text", "»", '"'),
]
PSEUDO_SPACES: list[Rule] = [
    ("text", _NBSP + "%", "%"),
    ("text", "nº" + _NBSP, "nº "),
    ("text", _NBSP + ":", ":"),
    ("text", _NBSP + "ºC", " ºC"),
    ("text", _NBSP + "cm", " cm"),
    ("text", _NBSP + "?", "?"),
    ("text", _NBSP + "!", "!"),
    ("text", _NBSP + ";", ";"),
    ("text", "," + _NBSP, ", "),
    _SQUEEZE,
]
ENGLISH_QUOTES: list[Rule] = [("regex", '"([,.]+)', '$1"')]
# Lines are rows here and carry no newline, so the end of a line counts as the character after the quote.
OTHER_QUOTES: list[Rule] = [("text", ',"', '",'), ("regex", r'([.]+)"(\s*(?:[^<]|$))', '"$1$2')]
OTHER_QUOTES_ALWAYS: list[Rule] = [("text", ',"', '",'), ("regex", r'([.]+)"', '"$1')]
COMMA_NUMBERS: list[Rule] = [("regex", f"([0-9]){_NBSP}([0-9])", "$1,$2")]
POINT_NUMBERS: list[Rule] = [("regex", f"([0-9]){_NBSP}([0-9])", "$1.$2")]
COMMA_LANGUAGES = ("de", "es", "cz", "cs", "fr")
UNQUOTED_LANGUAGES = ("cs", "cz")
CENTIMETRE_VARIANT: Rule = ("text", _NBSP + "cm`", " cm")


def punctuation_rules(lang: str, penn: bool = False, always: bool = False) -> list[Rule]:
    """The whole list for one language; ``always`` swaps a stop and a quote at the end of markup too, as the column variant does."""
    pseudo = [CENTIMETRE_VARIANT if always and r[1] == _NBSP + "cm" else r for r in PSEUDO_SPACES]
    rules = BRACKETS + ([] if penn else BACKQUOTES) + TYPOGRAPHIC + FRENCH_QUOTES + pseudo
    if lang == "en":
        rules = rules + ENGLISH_QUOTES
    elif lang not in UNQUOTED_LANGUAGES:
        rules = rules + (OTHER_QUOTES_ALWAYS if always else OTHER_QUOTES)
    return rules + (COMMA_NUMBERS if lang in COMMA_LANGUAGES else POINT_NUMBERS)


def unescape(column: Column, latin: bool = True) -> Column:
    """Entities unescaped up to three levels deep; lines without an ampersand skip the work."""
    rules = (ENTITIES + (LATIN_ENTITIES if latin else [])) * ROUNDS
    return F.when(column.contains("&"), apply(column, rules)).otherwise(column)


def printable(column: Column) -> Column:
    """Every control, format, unassigned or private character becomes a space."""
    return F.regexp_replace(column, r"\p{C}", " ")


def squeeze(column: Column) -> Column:
    return F.regexp_replace(column, "[ ][ ]+", " ")


def normalize_punctuation(column: Column, lang: Column | str, penn: bool = False, always: bool = False, languages: tuple[str, ...] = ("en", "de", "fr", "es", "cs", "cz")) -> Column:
    """Punctuation rules of each row's language; languages outside ``languages`` use the general rules.

    The rules that depend on the language come last, so the common part is
    folded once.
    """
    tail = lambda l: punctuation_rules(l, penn, always)[len(punctuation_rules("cs", penn, always)) - 1 :]
    common = apply(column, punctuation_rules("cs", penn, always)[:-1])
    if isinstance(lang, str):
        return apply(common, tail(lang))
    out = F.when(F.lit(False), common)
    for l in languages:
        out = out.when(lang == l, apply(common, tail(l)))
    return out.otherwise(apply(common, tail("other")))


def clean(column: Column, lang: Column | str, punctuation: bool = True) -> Column:
    """Unescape, keep printable, normalise, squeeze: in this order."""
    out = printable(unescape(column))
    return squeeze(normalize_punctuation(out, lang) if punctuation else out)
