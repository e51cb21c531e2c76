"""Tokenizers and token-level functions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.rules import Rule, apply

_DOT = "\ue000"
_CUT = "\ue001"
#: Brackets around the number of a protected piece.
_OPEN, _CLOSE = "\ue002", "\ue003"

# Rule groups of the rule-based tokenizer, in order.
WHITESPACE: list[Rule] = [("regex", r"(?U)\s+", " "), ("regex", r"[\x00-\x1f]", "")]
EDGES: list[Rule] = [("regex", " +", " "), ("regex", "^ ", ""), ("regex", " $", "")]
SPECIALS: list[Rule] = [("regex", r"([^\p{IsAlphabetic}\p{IsDigit}\s.'`,\-])", " $1 ")]
SPECIALS_COLON: list[Rule] = [("regex", r"([^\p{IsAlphabetic}\p{IsDigit}\s.:'`,\-])", " $1 "), ("regex", r"(:)(?=$|[^\p{Ll}])", " $1 ")]
HYPHENS: list[Rule] = [("regex", r"([\p{IsAlphabetic}\p{IsDigit}])-(?=[\p{IsAlphabetic}\p{IsDigit}])", "$1 @-@ ")]
COMMAS: list[Rule] = [("regex", r"([^\p{N}]),", "$1 , "), ("regex", r",([^\p{N}])", " , $1"), ("regex", r"(\p{N}),$", "$1 ,")]
APOSTROPHES_RIGHT: list[Rule] = [
    ("regex", r"([^\p{L}])'([^\p{L}])", "$1 ' $2"),
    ("regex", r"([^\p{L}\p{N}])'(\p{L})", "$1 ' $2"),
    ("regex", r"(\p{L})'([^\p{L}])", "$1 ' $2"),
    ("regex", r"(\p{L})'(\p{L})", "$1 '$2"),
    ("regex", r"(\p{N})'(s)", "$1 '$2"),
]
APOSTROPHES_LEFT: list[Rule] = [
    ("regex", r"([^\p{L}])'([^\p{L}])", "$1 ' $2"),
    ("regex", r"([^\p{L}])'(\p{L})", "$1 ' $2"),
    ("regex", r"(\p{L})'([^\p{L}])", "$1 ' $2"),
    ("regex", r"(\p{L})'(\p{L})", "$1' $2"),
]
APOSTROPHES_ALONE: list[Rule] = [("text", "'", " ' ")]
ESCAPES: list[Rule] = [
    ("text", "&", "&amp;"),
    ("text", "|", "&#124;"),
    ("text", "<", "&lt;"),
    ("text", ">", "&gt;"),
    ("text", "'", "&apos;"),
    ("text", '"', "&quot;"),
    ("text", "[", "&#91;"),
    ("text", "]", "&#93;"),
]
CJK_CLASS = r"[\x{2E80}-\x{9FFF}\x{A000}-\x{A4FF}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}]"
IS_CJK_CLASS = r"[\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{A840}-\x{A87F}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF65}-\x{FFDC}\x{20000}-\x{2FFFF}]"
CJK_RULES: list[Rule] = [
    ("regex", f"({CJK_CLASS})", " $1 "),
    ("regex", r"([^0-9])([.,])", "$1 $2 "),
    ("regex", r"([.,])([^0-9])", " $1 $2"),
    ("regex", r"([0-9])(-)", "$1 $2 "),
    ("regex", r"(?U)\s+", " "),
    ("regex", r"^\s+", ""),
    ("regex", r"\s+$", ""),
]
#: Abbreviations after which a stop doesn't end a sentence; class 2 only before a number.  A short list of common ones; pass your own tables.
PREFIXES: dict[str, dict[str, int]] = {
    "en": {p: 1 for p in "Mr Mrs Ms Dr Prof Gen Col Lt Sgt Capt Rev Sen Rep Gov St Jr Sr vs etc Inc Ltd Co Corp".split()} | {"No": 2, "Nos": 2, "Art": 2, "pp": 2},
    "de": {p: 1 for p in "Dr Prof Hr Fr bzw usw ca Abs Str evtl ggf inkl Nr vgl".split()},
    "fr": {p: 1 for p in "M MM Mme Mlle Dr Pr St Ste etc cf".split()},
    "es": {p: 1 for p in "Sr Sra Srta Dr Dra D Ud Uds etc".split()},
}
RIGHT_LANGUAGES, LEFT_LANGUAGES, COLON_LANGUAGES = ("en",), ("fr", "it", "ga"), ("fi", "sv")


def hyphens_split(column: Column) -> Column:
    return apply(column, HYPHENS)


def dots_masked(column: Column) -> Column:
    """Each run of two or more stops becomes a word of as many private marks."""
    masked = F.regexp_replace(column, r"\.(?=\.)|(?<=\.)\.", _DOT)
    return F.regexp_replace(masked, f"({_DOT}+)", " $1 ")


def dots_restored(column: Column) -> Column:
    return F.replace(column, F.lit(_DOT), F.lit("."))


def apostrophes(column: Column, lang: str) -> Column:
    return apply(column, APOSTROPHES_RIGHT if lang in RIGHT_LANGUAGES else APOSTROPHES_LEFT if lang in LEFT_LANGUAGES else APOSTROPHES_ALONE)


def bound(column: Column, f: Callable[[Column], Column]) -> Column:
    """``f(column)`` where ``column`` is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(column), f), F.lit(0))


def final_stops(column: Column, prefixes: dict[str, int]) -> Column:
    """Stops at word ends split off, unless the word is an abbreviation or the next word goes on in lower case."""
    table = F.create_map(*(F.lit(x) for kv in sorted(prefixes.items()) for x in kv)) if prefixes else None

    def word(w: Column, after: Column) -> Column:
        stem = F.substring(w, F.lit(1), F.length(w) - 1)
        kind = F.coalesce(F.element_at(table, stem), F.lit(0)) if prefixes else F.lit(0)
        acronym = stem.contains(".") & stem.rlike(r"\p{L}")
        keep = acronym | (kind == 1) | after.rlike(r"^\p{Ll}") | ((kind == 2) & after.rlike("^[0-9]"))
        return F.when(w.endswith(".") & w.rlike(r"^\S+\.$") & ~keep, F.concat(stem, F.lit(" ."))).otherwise(w)

    def joined(words: Column) -> Column:
        following = F.concat(F.slice(words, F.lit(2), F.size(words)), F.array(F.lit("")))
        return F.array_join(F.zip_with(words, following, word), " ")

    return bound(F.split(column, " "), joined)


def _with_protected(text: Column, patterns: list[str], f: Callable[[Column], Column]) -> Column:
    """``f(text)`` with every match of the regular expressions replaced by a numbered mark before and put back after."""

    def marked(i: Column) -> Column:
        return F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))

    def run(t: Column) -> Column:
        matches = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in patterns))
        found = F.transform(matches, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
        hidden = F.aggregate(found, t, lambda done, x: F.replace(done, x["m"], F.concat(F.lit(" "), marked(x["i"]), F.lit(" "))))
        return F.aggregate(found, f(hidden), lambda done, x: F.replace(done, marked(x["i"]), x["m"]))

    return bound(text, run)


def tokenize(column: Column, lang: str, aggressive: bool = True, escape: bool = False, prefixes: dict[str, int] | None = None, protected: list[str] | None = None, skip_markup: bool = False) -> Column:
    """The rule-based tokenizer for one language; blank lines stay as they are.

    What matches one of the regular expressions in ``protected`` is kept whole;
    with ``skip_markup`` so are lines that are one tag.  ``prefixes``: see
    ``sources.corpus.nonbreaking_prefixes``.
    """
    specials = SPECIALS_COLON if lang in COLON_LANGUAGES else SPECIALS
    if protected:
        specials = [(kind, pattern.replace(r"\s.", rf"\s{_OPEN}{_CLOSE}."), to) for kind, pattern, to in specials]

    def rules(text: Column) -> Column:
        text = apply(text, EDGES + specials)
        if aggressive:
            text = hyphens_split(text)
        text = apply(dots_masked(text), COMMAS)
        text = apply(apostrophes(text, lang), EDGES)
        text = final_stops(text, PREFIXES.get(lang, PREFIXES["en"]) if prefixes is None else prefixes)
        return F.regexp_replace(apply(text, EDGES), r"\.' ?$", " . ' ")

    text = apply(F.concat(F.lit(" "), column, F.lit(" ")), WHITESPACE)
    text = _with_protected(text, protected, rules) if protected else rules(text)
    text = apply(dots_restored(text), EDGES)
    whole = column.rlike(r"^\s*$")
    if skip_markup:
        whole = whole | column.rlike(r"^<.+>$")
    return F.when(whole, column).otherwise(apply(text, ESCAPES) if escape else text)


# Rules of the treebank tokenizer, in order.
TREEBANK: list[Rule] = [
    *WHITESPACE,
    ("regex", "^``", "`` "),
    ("regex", '^"', "`` "),
    ("regex", "^`([^`])", "` $1"),
    ("regex", "^'", "`  "),
    ("regex", r'([ (\[{<])"', "$1 `` "),
    ("regex", r"([ (\[{<])``", "$1 `` "),
    ("regex", r"([ (\[{<])`([^`])", "$1 ` $2"),
    ("regex", r"([ (\[{<])'", "$1 ` "),
    ("text", "...", " _ELLIPSIS_ "),
    ("regex", r"([^\p{N}]),([^\p{N}])", "$1 , $2"),
    ("regex", r"(\p{N}),([^\p{N}])", "$1 , $2"),
    ("regex", r"([^\p{N}]),(\p{N})", "$1 , $2"),
    ("regex", r"([;:@#$%&\p{Sc}\p{So}])", " $1 "),
    ("regex", r"([\p{IsAlphabetic}\p{IsDigit}])/([\p{IsAlphabetic}\p{IsDigit}])", "$1 @/@ $2"),
    ("regex", r"""([^.])([.])([\])}>"']*) ?$""", "$1 $2$3 "),
    ("regex", "([?!])", " $1 "),
    ("regex", r"([\]\[(){}<>])", " $1 "),
    ("text", "(", "-LRB-"),
    ("text", ")", "-RRB-"),
    ("text", "[", "-LSB-"),
    ("text", "]", "-RSB-"),
    ("text", "{", "-LCB-"),
    ("text", "}", "-RCB-"),
    ("text", "--", " -- "),
    ("regex", "$", " "),
    ("regex", "^", " "),
    ("text", '"', " '' "),
    ("regex", "([^'])' ", "$1 ' "),
    ("regex", "'([sSmMdD]) ", " '$1 "),
    ("regex", "('ll|'re|'ve|n't|'LL|'RE|'VE|N'T) ", " $1 "),
    ("regex", " ([Cc])annot ", " $1an not "),
    ("regex", " ([Dd])'ye ", " $1' ye "),
    ("regex", " ([Gg])imme ", " $1im me "),
    ("regex", " ([Gg])onna ", " $1on na "),
    ("regex", " ([Gg])otta ", " $1ot ta "),
    ("regex", " ([Ll])emme ", " $1em me "),
    ("regex", " ([Mm])ore'n ", " $1ore 'n "),
    ("regex", " '([Tt])is ", " '$1 is "),
    ("regex", " '([Tt])was ", " '$1 was "),
    ("regex", " ([Ww])anna ", " $1an na "),
    *EDGES,
]


def tokenize_treebank(column: Column, prefixes: dict[str, int] | None = None, escape: bool = True) -> Column:
    text = final_stops(apply(column, TREEBANK), PREFIXES["en"] if prefixes is None else prefixes)
    text = apply(text, [("text", "_ELLIPSIS_", "..."), *EDGES])
    return apply(text, ESCAPES) if escape else text


# The public rules that corpus BLEU tokenises with ("13a").
BLEU_13A: list[Rule] = [
    ("text", "<skipped>", ""),
    ("text", "&quot;", '"'),
    ("text", "&amp;", "&"),
    ("text", "&lt;", "<"),
    ("text", "&gt;", ">"),
    ("regex", r"([{-~\[-` -&(-+:-@/])", " $1 "),
    ("regex", r"([^0-9])([.,])", "$1 $2 "),
    ("regex", r"([.,])([^0-9])", " $1 $2"),
    ("regex", r"([0-9])(-)", "$1 $2 "),
    ("regex", " +", " "),
    ("regex", "^ ", ""),
    ("regex", " $", ""),
]
DETOKENIZE: list[Rule] = [
    ("text", " @-@ ", "-"),
    ("text", "&apos;", "'"),
    ("text", "&quot;", '"'),
    ("text", "&#124;", "|"),
    ("text", "&#91;", "["),
    ("text", "&#93;", "]"),
    ("text", "&lt;", "<"),
    ("text", "&gt;", ">"),
    ("text", "&amp;", "&"),
    ("regex", r" ([,.?!:;%)\]}]+)", "$1"),
    ("regex", r"([(\[{$#]) ", "$1"),
]
DETOKENIZE_RIGHT: list[Rule] = [("regex", " (n't|'(s|m|d|ll|re|ve)) ", "$1 "), ("regex", " (n't|'(s|m|d|ll|re|ve))$", "$1")]
DETOKENIZE_LEFT: list[Rule] = [("regex", r"(\p{L}') ", "$1")]


def tokenize_bleu(column: Column) -> Column:
    """The tokenisation that corpus BLEU is reported with."""
    return apply(F.concat(F.lit(" "), column, F.lit(" ")), BLEU_13A)


def detokenize(column: Column, lang: str) -> Column:
    """Tokens as running text: punctuation, contractions and escapes joined again."""
    own = DETOKENIZE_RIGHT if lang in RIGHT_LANGUAGES else DETOKENIZE_LEFT if lang in LEFT_LANGUAGES else []
    return apply(column, DETOKENIZE + own + EDGES)


def split_cjk(column: Column) -> Column:
    """Blanks around each CJK character, stops and commas detached from what isn't a digit."""
    return apply(column, CJK_RULES)


def has_cjk(column: Column) -> Column:
    return column.rlike(IS_CJK_CLASS)


def join_cjk(column: Column) -> Column:
    """Blanks that don't touch a Latin letter go; a final stop becomes an ideographic one."""
    return F.regexp_replace(F.regexp_replace(column, r"(?U)(?<![a-zA-Z])\s(?![a-zA-Z])", ""), r"\.$", "。")


def without_subwords(column: Column, mark: str = "@@ ") -> Column:
    return F.rtrim(F.replace(F.concat(column, F.lit(" ")), F.lit(mark), F.lit("")))


def joined_subwords(pieces: Column, mark: str = "@@") -> Column:
    """A list of pieces as text; a mark at the end goes too."""
    return F.regexp_replace(F.replace(F.array_join(pieces, " "), F.lit(f"{mark} "), F.lit("")), f"{mark}$", "")


def language_tag(lang: Column) -> Column:
    return F.concat(F.lit("LANG_TOK_"), F.upper(lang))


def tagged(lang: Column, text: Column) -> Column:
    return F.concat_ws(" ", language_tag(lang), text)


def tag_language(tag: Column) -> Column:
    return F.lower(F.substring(tag, 10, 1 << 20))


def tokens(column: Column) -> Column:
    return F.filter(F.split(column, " "), lambda w: F.length(w) > 0)


def length_ratio(src_len: Column, trg_len: Column) -> Column:
    return F.when(trg_len > 0, src_len / trg_len).otherwise(F.lit(0.0))


def _around(entry: str):
    return lambda w: F.replace(w, F.lit(entry), F.lit(f"{_CUT}{entry}{_CUT}"))


def isolate(words: Column, glossary: list[str]) -> Column:
    """Glossary entries inside words become words of their own."""
    for g in glossary:
        marked = F.transform(words, _around(g))
        words = F.filter(F.split(F.array_join(marked, _CUT), _CUT), lambda x: F.length(x) > 0)
    return words
