"""The query catalogue over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import cleaning, tokenizing
from lexiloom.functions.rules import quoted
from lexiloom.operators import corpora, evaluation, lexicon, sampling, vocabulary
from lexiloom.sources import corpus
from lexiloom.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_LINES = """l AS (
    SELECT d.doc_id, d.lang, CAST(t.i AS BIGINT) AS line_no, d.s[CAST(t.i AS INTEGER) + 1] AS line
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents) d, unnest(range(len(d.s))) AS t(i)
)"""
_TOKENS = "w AS (SELECT lang, unnest(string_split(line, ' ')) AS token FROM l)"
_COUNTS = "c AS (SELECT token, CAST(count(*) AS BIGINT) AS freq FROM w WHERE length(token) > 0 GROUP BY token)"
_TURNS = """p AS (
    SELECT a.conv_id, a.turn, a.text AS src, b.text AS trg
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'
)"""


def _sql_draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 7) AS BIGINT)"


def _replaced(expression: str, *rules: tuple[str, str]) -> str:
    """Nested regexp_replace calls of (pattern, replacement), written as the SQL engine reads them."""
    for pattern, replacement in rules:
        expression = f"regexp_replace({expression}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return expression

# The rules once more, by hand: nothing of this comes from the tables that the DataFrame side applies.
_SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TRIMMED = [(" +", " "), ("^ ", ""), (" $", "")]
_COMMAS = [(r"([^\p{N}]),", r"\1 , "), (r",([^\p{N}])", r" , \1"), (r"(\p{N}),$", r"\1 ,")]
_QUOTES_EN = [(r"([^\p{L}])'([^\p{L}])", r"\1 ' \2"), (r"([^\p{L}\p{N}])'(\p{L})", r"\1 ' \2"), (r"(\p{L})'([^\p{L}])", r"\1 ' \2"), (r"(\p{L})'(\p{L})", r"\1 '\2"), (r"(\p{N})'(s)", r"\1 '\2")]
_QUOTES_FR = [(r"([^\p{L}])'([^\p{L}])", r"\1 ' \2"), (r"([^\p{L}])'(\p{L})", r"\1 ' \2"), (r"(\p{L})'([^\p{L}])", r"\1 ' \2"), (r"(\p{L})'(\p{L})", r"\1' \2")]
_QUOTES_ALONE = [("'", " ' ")]
_PUNCTUATION = [
    ("\\r", ""), (r"\(", " ("), (r"\)", ") "), (" +", " "), (r"\) ([.!:?;,])", r")\1"), (r"\( ", "("), (r" \)", ")"), ("([0-9]) %", r"\1%"), (" :", ":"), (" ;", ";"),
    ("`", "'"), ("''", ' " '), ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), (" +", " "), ("´", "'"),
    ("([a-zA-Z])‘([a-zA-Z])", r"\1'\2"), ("([a-zA-Z])’([a-zA-Z])", r"\1'\2"), ("‘", '"'), ("‚", '"'), ("’", '"'), ("''", '"'), ("´´", '"'), ("…", "..."),
    (r"\x{A0}«\x{A0}", ' "'), (r"«\x{A0}", '"'), ("«", '"'), (r"\x{A0}»\x{A0}", '" '), (r"\x{A0}»", '"'), ("»", '"'),
    (r"\x{A0}%", "%"), (r"nº\x{A0}", "nº "), (r"\x{A0}:", ":"), (r"\x{A0}ºC", " ºC"), (r"\x{A0}cm", " cm"), (r"\x{A0}\?", "?"), (r"\x{A0}!", "!"), (r"\x{A0};", ";"), (r",\x{A0}", ", "), (" +", " "),
]
_PUNCTUATION_OF = {
    "en": [('"([,.]+)', r'\1"'), (r"([0-9])\x{A0}([0-9])", r"\1.\2")],
    "other": [(',"', '",'), (r'([.]+)"(\s*(?:[^<]|$))', r'"\1\2'), (r"([0-9])\x{A0}([0-9])", r"\1,\2")],
}


def _punctuation_sql(expression: str, lang: str) -> str:
    return _replaced(expression, *_PUNCTUATION, *_PUNCTUATION_OF["en" if lang == "en" else "other"])


def _escaped(expression: str) -> str:
    for sign, name in (("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;")):
        expression = f"replace({expression}, {quoted(sign)}, {quoted(name)})"
    return expression


def _public_tokens(column: str) -> str:
    plain = f"' ' || {column} || ' '"
    for old, new in (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        plain = f"replace({plain}, {quoted(old)}, {quoted(new)})"
    return _replaced(plain, (r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))


def _unescaped_sql(expression: str) -> str:
    """Three rounds of twelve named or numbered entities and of those of the letters from à to ÿ."""
    names = [("&bar;", "|"), ("&#124;", "|"), ("&lt;", "<"), ("&gt;", ">"), ("&bra;", "["), ("&ket;", "]"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&")]
    for _ in range(3):
        for name, sign in names:
            expression = f"replace({expression}, {quoted(name)}, {quoted(sign)})"
        for code in range(224, 256):
            expression = f"replace({expression}, '&#{code};', chr({code}))"
    return expression



def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return corpus.table(spark, d, name)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.lines(table(spark, d, "documents").select("doc_id", "lang", "text"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return corpus.turns(table(spark, d, "conversations"))


# -- scans and counts ---------------------------------------------------------


@query("lines_scan", f"WITH {_LINES} SELECT doc_id, lang, line_no, line FROM l")
def lines_scan(spark, d):
    return lines(spark, d).select("doc_id", "lang", "line_no", "line")


@query("lang_line_counts", f"WITH {_LINES} SELECT lang, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY lang")
def lang_line_counts(spark, d):
    return lines(spark, d).groupBy("lang").agg(F.count("*").alias("n"))


@query("max_lang_count", f"WITH {_LINES} SELECT CAST(max(n) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM l GROUP BY lang)")
def max_lang_count(spark, d):
    return lang_line_counts(spark, d).agg(F.max("n").alias("most"))


# -- cleaning -----------------------------------------------------------------

_UNESCAPED = _unescaped_sql("html")


@query("page_deescape", f"SELECT page_id, regexp_replace(regexp_replace({_UNESCAPED}, '\\p{{C}}', ' ', 'g'), '[ ][ ]+', ' ', 'g') AS text FROM pages")
def page_deescape(spark, d):
    return table(spark, d, "pages").select("page_id", cleaning.squeeze(cleaning.printable(cleaning.unescape(F.col("html")))).alias("text"))


def _punctuated(lang: str, always: bool = False) -> tuple[Query, str]:
    def run(spark, d):
        return lines(spark, d).where(F.col("lang") == lang).select("doc_id", "line_no", cleaning.normalize_punctuation(F.col("line"), lang, always=always).alias("text"))

    return run, f"WITH {_LINES} SELECT doc_id, line_no, {_punctuation_sql('line', lang)} AS text FROM l WHERE lang = {quoted(lang)}"


for _lang in ("en", "de", "fr", "es"):
    _run, _sql = _punctuated(_lang)
    query(f"norm_punct_{_lang}", _sql)(_run)
_run, _sql = _punctuated("en", always=True)
query("norm_punct_columns", _sql)(_run)


_SHOWN = f"regexp_replace({_unescaped_sql('line')}, '\\p{{C}}', ' ', 'g')"
_CLEANED_BY = " ".join(f"WHEN {quoted(l)} THEN regexp_replace({_punctuation_sql('shown', l)}, '[ ][ ]+', ' ', 'g')" for l in ("en", "de", "fr", "es"))


@query("clean_lines", f"WITH {_LINES}, h AS (SELECT doc_id, line_no, lang, {_SHOWN} AS shown FROM l) SELECT doc_id, line_no, CASE lang {_CLEANED_BY} END AS text FROM h")
def clean_lines(spark, d):
    return lines(spark, d).select("doc_id", "line_no", cleaning.clean(F.col("line"), F.col("lang")).alias("text"))


_INJECTED = "'„' || line || '” – 5 % (a) : 10' || chr(160) || '000 l’eau ''''x'''' ... « y »'"


@query("norm_punct_injected", f"WITH {_LINES} SELECT doc_id, line_no, {_punctuation_sql(_INJECTED, 'fr')} AS text FROM l")
def norm_punct_injected(spark, d):
    text = F.concat(F.lit("„"), F.col("line"), F.lit("” – 5 % (a) : 10\u00a0000 l’eau ''x'' ... « y »"))
    return lines(spark, d).select("doc_id", "line_no", cleaning.normalize_punctuation(text, "fr").alias("text"))


# -- tokenizing ---------------------------------------------------------------

_SPECIALS_SQL = (r"([^\p{L}\p{Nd}\s.'`,\-])", r" \1 ")


@query("tok_specials", f"WITH {_LINES} SELECT doc_id, line_no, {_replaced('line', _SPECIALS_SQL)} AS text FROM l")
def tok_specials(spark, d):
    from lexiloom.functions.rules import apply

    return lines(spark, d).select("doc_id", "line_no", apply(F.col("line"), tokenizing.SPECIALS).alias("text"))


@query("tok_commas", f"WITH {_LINES} SELECT doc_id, line_no, {_replaced('line', *_COMMAS)} AS text FROM l")
def tok_commas(spark, d):
    from lexiloom.functions.rules import apply

    return lines(spark, d).select("doc_id", "line_no", apply(F.col("line"), tokenizing.COMMAS).alias("text"))


for _lang, _rules in (("en", _QUOTES_EN), ("fr", _QUOTES_FR), ("other", _QUOTES_ALONE)):

    def _apostrophes(spark, d, lang=_lang):
        text = F.concat(F.col("text"), F.lit(" it's l'eau 1990's ' x'"))
        return table(spark, d, "conversations").select("conv_id", "turn", tokenizing.apostrophes(text, lang).alias("text"))

    query(f"tok_apostrophe_{_lang}", f"SELECT conv_id, turn, {_replaced('text || ' + quoted(" it's l'eau 1990's ' x'"), *_rules)} AS text FROM conversations")(_apostrophes)

_HYPHEN_SQL = [(r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", r"\1 @-@ \2")] * 2


@query("tok_hyphen", f"WITH {_LINES} SELECT doc_id, line_no, {_replaced('line', *_HYPHEN_SQL)} AS text FROM l")
def tok_hyphen(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tokenizing.hyphens_split(F.col("line")).alias("text"))


@query("tok_multidot", f"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(line || '... a..b', '([.][.]+)', ' \\1 ', 'g') AS text FROM l")
def tok_multidot(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tokenizing.dots_restored(tokenizing.dots_masked(F.concat("line", F.lit("... a..b")))).alias("text"))


@query(
    "tok_nonbreaking",
    f"""WITH {_LINES}, w AS (
        SELECT l.doc_id, l.line_no, t.i, l.s[CAST(t.i AS INTEGER) + 1] AS word, coalesce(l.s[CAST(t.i AS INTEGER) + 2], '') AS after
        FROM (SELECT doc_id, line_no, string_split(line, ' ') AS s FROM l WHERE lang = 'en') l, unnest(range(len(l.s))) AS t(i)
    ), x AS (
        SELECT doc_id, line_no, i, word, after, substr(word, 1, length(word) - 1) AS stem,
            CASE WHEN substr(word, 1, length(word) - 1) IN ({', '.join(quoted(k) for k, v in tokenizing.PREFIXES['en'].items() if v == 1)}) THEN 1
                 WHEN substr(word, 1, length(word) - 1) IN ({', '.join(quoted(k) for k, v in tokenizing.PREFIXES['en'].items() if v == 2)}) THEN 2 ELSE 0 END AS kind
        FROM w
    )
    SELECT doc_id, line_no, string_agg(CASE WHEN regexp_matches(word, '^\\S+[.]$') AND NOT (
            (contains(stem, '.') AND regexp_matches(stem, '\\p{{L}}')) OR kind = 1 OR regexp_matches(after, '^\\p{{Ll}}') OR (kind = 2 AND regexp_matches(after, '^[0-9]')))
        THEN stem || ' .' ELSE word END, ' ' ORDER BY i) AS text
    FROM x GROUP BY doc_id, line_no""",
)
def tok_nonbreaking(spark, d):
    rows = lines(spark, d).where("lang = 'en'")
    return rows.select("doc_id", "line_no", tokenizing.final_stops(F.col("line"), tokenizing.PREFIXES["en"]).alias("text"))


_OPENED = _replaced("' ' || line || ' '", (_SPACE, " "), (r"[\x00-\x1f]", ""), *_TRIMMED)
_APART = _replaced(_OPENED, (r"([^\p{L}\p{Nd}\s.'`,\-])", r" \1 "), (r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", r"\1 @-@ \2"), (r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", r"\1 @-@ \2"))
_DOTTED = _replaced(f"replace({_APART}, '..', chr(57344) || chr(57344))", (r"(\x{E000})[.]", "\\1\ue000"), (r"(\x{E000}+)", r" \1 "))
_COMMAS_CUT = _replaced(_DOTTED, *_COMMAS)
_SHORT = {
    "en": "'Mr', 'Mrs', 'Ms', 'Dr', 'Prof', 'Gen', 'Col', 'Lt', 'Sgt', 'Capt', 'Rev', 'Sen', 'Rep', 'Gov', 'St', 'Jr', 'Sr', 'vs', 'etc', 'Inc', 'Ltd', 'Co', 'Corp'",
    "de": "'Dr', 'Prof', 'Hr', 'Fr', 'bzw', 'usw', 'ca', 'Abs', 'Str', 'evtl', 'ggf', 'inkl', 'Nr', 'vgl'",
    "fr": "'M', 'MM', 'Mme', 'Mlle', 'Dr', 'Pr', 'St', 'Ste', 'etc', 'cf'",
    "es": "'Sr', 'Sra', 'Srta', 'Dr', 'Dra', 'D', 'Ud', 'Uds', 'etc'",
}


def _stops(words: str, short: str, numeric: str) -> str:
    """Words with their final stop split off where it isn't an abbreviation's, as one text."""
    stem, after = "substr(q, 1, length(q) - 1)", f"coalesce({words}[i + 1], '')"
    keep = rf"(contains({stem}, '.') AND regexp_matches({stem}, '\p{{L}}')) OR {stem} IN ({short}) OR regexp_matches({after}, '^\p{{Ll}}') OR ({stem} IN ({numeric}) AND regexp_matches({after}, '^[0-9]'))"
    return rf"array_to_string(list_transform({words}, lambda q, i: CASE WHEN regexp_matches(q, '^\S+[.]$') AND NOT ({keep}) THEN {stem} || ' .' ELSE q END), ' ')"


_QUOTED = f"CASE lang WHEN 'en' THEN {_replaced('x', *_QUOTES_EN, *_TRIMMED)} WHEN 'fr' THEN {_replaced('x', *_QUOTES_FR, *_TRIMMED)} ELSE {_replaced('x', (chr(39), ' ' + chr(39) + ' '), *_TRIMMED)} END"
_STOPPED = "CASE lang " + " ".join(f"WHEN '{l}' THEN {_stops('ws', short, chr(39) + 'No' + chr(39) + ', ' + chr(39) + 'Nos' + chr(39) + ', ' + chr(39) + 'Art' + chr(39) + ', ' + chr(39) + 'pp' + chr(39) if l == 'en' else 'NULL')}" for l, short in _SHORT.items()) + " END"
_MOSES = f"""{_LINES}, x1 AS (SELECT *, {_COMMAS_CUT} AS x FROM l), x2 AS (SELECT doc_id, line_no, lang, line, string_split({_QUOTED}, ' ') AS ws FROM x1), x3 AS (SELECT doc_id, line_no, line, {_STOPPED} AS y FROM x2)"""


@query("tok_moses_full", f"WITH {_MOSES} SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\\s*$') THEN line ELSE {_replaced('replace(' + _replaced('y', *_TRIMMED, (chr(92) + '.' + chr(39) + ' ?$', ' . ' + chr(39) + ' ')) + ', chr(57344), ' + quoted('.') + ')', *_TRIMMED)} END AS text FROM x3")
def tok_moses_full(spark, d):
    out = F.when(F.lit(False), F.col("line"))
    for l in ("en", "de", "fr", "es"):
        out = out.when(F.col("lang") == l, tokenizing.tokenize(F.col("line"), l))
    return lines(spark, d).select("doc_id", "line_no", out.alias("text"))


@query(
    "tok_protected",
    f"SELECT doc_id, '<x' || doc_id || '> , a.b-c@d.org :' AS text FROM documents",
)
def tok_protected(spark, d):
    """Tags and addresses at the head of a line, kept whole by regular expressions."""
    head = F.concat(F.lit("<x"), F.col("doc_id").cast("string"), F.lit(">, a.b-c@d.org:"))
    return table(spark, d, "documents").select("doc_id", tokenizing.tokenize(head, "en", protected=["<[^>]+>", r"[a-z.\-]+@[a-z.]+"]).alias("text"))


_PENN = [
    (_SPACE, " "), (r"[\x00-\x1f]", ""), ("^``", "`` "), ('^"', "`` "), ("^`([^`])", r"` \1"), ("^'", "`  "),
    (r'([ (\[{<])"', r"\1 `` "), (r"([ (\[{<])``", r"\1 `` "), (r"([ (\[{<])`([^`])", r"\1 ` \2"), (r"([ (\[{<])'", r"\1 ` "),
    (r"\.\.\.", " _ELLIPSIS_ "), (r"([^\p{N}]),([^\p{N}])", r"\1 , \2"), (r"(\p{N}),([^\p{N}])", r"\1 , \2"), (r"([^\p{N}]),(\p{N})", r"\1 , \2"),
    (r"([;:@#$%&\p{Sc}\p{So}])", r" \1 "), (r"([\p{L}\p{Nd}])/([\p{L}\p{Nd}])", r"\1 @/@ \2"), ("([^.])([.])([\\])}>\"']*) ?$", r"\1 \2\3 "),
    ("([?!])", r" \1 "), (r"([\]\[(){}<>])", r" \1 "), (r"\(", "-LRB-"), (r"\)", "-RRB-"), (r"\[", "-LSB-"), (r"\]", "-RSB-"), (r"\{", "-LCB-"), (r"\}", "-RCB-"),
    ("--", " -- "), ("$", " "), ("^", " "), ('"', " '' "), ("([^'])' ", r"\1 ' "), ("'([sSmMdD]) ", r" '\1 "),
    ("'ll ", " 'll "), ("'re ", " 're "), ("'ve ", " 've "), ("n't ", " n't "), ("'LL ", " 'LL "), ("'RE ", " 'RE "), ("'VE ", " 'VE "), ("N'T ", " N'T "),
    (" ([Cc])annot ", r" \1an not "), (" ([Dd])'ye ", r" \1' ye "), (" ([Gg])imme ", r" \1im me "), (" ([Gg])onna ", r" \1on na "), (" ([Gg])otta ", r" \1ot ta "),
    (" ([Ll])emme ", r" \1em me "), (" ([Mm])ore'n ", r" \1ore 'n "), (" '([Tt])is ", r" '\1 is "), (" '([Tt])was ", r" '\1 was "), (" ([Ww])anna ", r" \1an na "), *_TRIMMED,
]
_PENN_WORDS = "string_split(" + _replaced("line", *_PENN) + ", ' ')"
_PENN_NUMERIC = "'No', 'Nos', 'Art', 'pp'"


@query("tok_penn", f"WITH {_LINES}, x1 AS (SELECT doc_id, line_no, {_PENN_WORDS} AS ws FROM l WHERE lang = 'en') SELECT doc_id, line_no, {_escaped(_replaced('replace(' + _stops('ws', _SHORT['en'], _PENN_NUMERIC) + ', ' + quoted('_ELLIPSIS_') + ', ' + quoted('...') + ')', *_TRIMMED))} AS text FROM x1")
def tok_penn(spark, d):
    return lines(spark, d).where("lang = 'en'").select("doc_id", "line_no", tokenizing.tokenize_treebank(F.col("line")).alias("text"))


@query("tok_bleu", f"WITH {_LINES} SELECT doc_id, line_no, {_replaced(_public_tokens('line'), *_TRIMMED)} AS text FROM l")
def tok_bleu(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tokenizing.tokenize_bleu(F.col("line")).alias("text"))


_SPACED = [("regex", "([,.()])", " $1 ")]


_JOINED = _replaced(
    "line", (r"([,.()])", r" \1 "), (" @-@ ", "-"), ("&apos;", "'"), ("&quot;", '"'), ("&#124;", "|"), ("&#91;", "["), ("&#93;", "]"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    (r" ([,.?!:;%)\]}]+)", r"\1"), (r"([(\[{$#]) ", r"\1"), (" (n't|'(s|m|d|ll|re|ve)) ", r"\1 "), (" (n't|'(s|m|d|ll|re|ve))$", r"\1"), *_TRIMMED,
)


@query("detokenize", f"WITH {_LINES} SELECT doc_id, line_no, {_JOINED} AS text FROM l")
def detokenize(spark, d):
    from lexiloom.functions.rules import apply

    return lines(spark, d).select("doc_id", "line_no", tokenizing.detokenize(apply(F.col("line"), _SPACED), "en").alias("text"))


@query("tok_escape", f"WITH {_LINES} SELECT doc_id, line_no, {_escaped('line')} AS text FROM l")
def tok_escape(spark, d):
    from lexiloom.functions.rules import apply

    return lines(spark, d).select("doc_id", "line_no", apply(F.col("line"), tokenizing.ESCAPES).alias("text"))


_CJK_TEXT = "你好,world 3.5 한국-1, "


_CJK_APART = _replaced(
    f"{quoted(_CJK_TEXT)} || line", (r"([\x{2E80}-\x{9FFF}\x{A000}-\x{A4FF}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "), (_SPACE, " "), (r"^\s+", ""), (r"\s+$", ""),
)


@query("cjk_split", f"WITH {_LINES} SELECT doc_id, line_no, {_CJK_APART} AS text FROM l")
def cjk_split(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tokenizing.split_cjk(F.concat(F.lit(_CJK_TEXT), F.col("line"))).alias("text"))


@query("cjk_flag", f"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN text || '한' ELSE text END, {quoted(tokenizing.IS_CJK_CLASS)}) AS cjk FROM documents")
def cjk_flag(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("한"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tokenizing.has_cjk(text).alias("cjk"))


_CJK_WORDS = "你 好 ok 世 界 ３ 한 국 a b "


@query(
    "cjk_deseg",
    rf"""WITH {_LINES}, s AS (SELECT doc_id, line_no, {quoted(_CJK_WORDS)} || line || CASE WHEN doc_id % 2 = 0 THEN ' 。 x .' ELSE '' END AS x FROM l)
    SELECT doc_id, line_no, regexp_replace(array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN regexp_full_match(substr(x, i, 1), '{_SPACE}') AND NOT ((i > 1 AND regexp_full_match(substr(x, i - 1, 1), '[a-zA-Z]')) OR regexp_full_match(substr(x, i + 1, 1), '[a-zA-Z]')) THEN '' ELSE substr(x, i, 1) END), ''), '\.$', '。') AS text FROM s""",
)
def cjk_deseg(spark, d):
    text = F.concat(F.lit(_CJK_WORDS), F.col("line"), F.when(F.col("doc_id") % 2 == 0, F.lit(" 。 x .")).otherwise(F.lit("")))
    return lines(spark, d).select("doc_id", "line_no", tokenizing.join_cjk(text).alias("text"))


@query("remove_bpe", f"WITH {_LINES} SELECT doc_id, line_no, rtrim(replace(replace(line, 'th', 't@@ h') || ' ', '@@ ', '')) AS text FROM l")
def remove_bpe(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tokenizing.without_subwords(F.replace("line", F.lit("th"), F.lit("t@@ h"))).alias("text"))


@query("bpe_decode", f"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(replace(replace(line, 'e', 'e@@ ') || 'x@@', '@@ ', ''), '@@$', '') AS text FROM l")
def bpe_decode(spark, d):
    pieces = F.split(F.concat(F.replace("line", F.lit("e"), F.lit("e@@ ")), F.lit("x@@")), " ")
    return lines(spark, d).select("doc_id", "line_no", tokenizing.joined_subwords(pieces).alias("text"))


@query("lang_tag", f"WITH {_LINES} SELECT doc_id, line_no, 'LANG_TOK_' || upper(lang) || ' ' || line AS text FROM l")
def lang_tag(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tokenizing.tagged(F.col("lang"), F.col("line")).alias("text"))


@query("strip_tag", f"WITH {_LINES} SELECT doc_id, line_no, lang AS tag_lang, line AS text FROM l")
def strip_tag(spark, d):
    t = lang_tag(spark, d)
    tag = F.substring_index("text", " ", 1)
    return t.select("doc_id", "line_no", tokenizing.tag_language(tag).alias("tag_lang"), F.expr("substring(text, length(substring_index(text, ' ', 1)) + 2)").alias("text"))


@query("sent_len", f"WITH {_LINES} SELECT doc_id, line_no, CAST(len(list_filter(string_split(line, ' '), lambda x: length(x) > 0)) AS BIGINT) AS n FROM l")
def sent_len(spark, d):
    return lines(spark, d).select("doc_id", "line_no", F.size(tokenizing.tokens(F.col("line"))).cast("bigint").alias("n"))


# -- parallel corpora ---------------------------------------------------------

_LEN = "CAST(len(list_filter(string_split({0}, ' '), lambda x: length(x) > 0)) AS BIGINT)"
_RATIO = f"r AS (SELECT conv_id, turn, {_LEN.format('src')} AS src_len, {_LEN.format('trg')} AS trg_len FROM p)"
_RATIO_OF = "round(CASE WHEN trg_len > 0 THEN src_len / trg_len ELSE 0 END, 6)"


@query("parallel_zip", f"WITH {_TURNS} SELECT conv_id, turn, src, trg FROM p")
def parallel_zip(spark, d):
    return turns(spark, d).select("conv_id", "turn", "src", "trg")


@query(
    "positional_zip",
    "SELECT coalesce(a.i, b.i) AS line_no, coalesce(a.text, '') AS src, coalesce(b.text, '') AS trg FROM (SELECT doc_id // 2 AS i, text FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id // 2 + 5 AS i, text FROM documents WHERE doc_id % 2 = 1) b ON a.i = b.i",
)
def positional_zip(spark, d):
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 2 = 0").select(F.expr("doc_id div 2").alias("line_no"), "text")
    b = docs.where("doc_id % 2 = 1").select(F.expr("doc_id div 2 + 5").alias("line_no"), "text")
    return corpus.parallel_corpus(a, b)


@query("pair_dedup", f"WITH {_TURNS} SELECT DISTINCT src, trg FROM p")
def pair_dedup(spark, d):
    return corpora.distinct_pairs(turns(spark, d).select("src", "trg"))


@query("line_dedup", f"WITH {_LINES} SELECT DISTINCT lang, line FROM l")
def line_dedup(spark, d):
    return lines(spark, d).select("lang", "line").distinct()


@query("length_ratio", f"WITH {_TURNS}, {_RATIO} SELECT conv_id, turn, src_len, trg_len, {_RATIO_OF} AS ratio FROM r")
def length_ratio(spark, d):
    return corpora.with_ratio(turns(spark, d)).select("conv_id", "turn", "src_len", "trg_len", F.round("ratio", 6).alias("ratio"))


@query("ratio_filter", f"WITH {_TURNS}, {_RATIO} SELECT conv_id, turn FROM r WHERE {_RATIO_OF} BETWEEN 0.5 AND 2")
def ratio_filter(spark, d):
    return corpora.within_ratio(length_ratio(spark, d), 0.5, 2.0).select("conv_id", "turn")


def _pairs(spark, d) -> DataFrame:
    return turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("en").alias("src_lang"), F.lit("de").alias("trg_lang"), "src", "trg")


_BOTH = f"WITH {_TURNS}, b AS (SELECT conv_id * 1000 + turn AS id, 'en' AS src_lang, 'de' AS trg_lang, src, trg FROM p UNION ALL SELECT conv_id * 1000 + turn, 'de', 'en', trg, src FROM p)"


@query("bidirectional_merge", f"{_BOTH} SELECT id, src_lang, trg_lang, src, trg FROM b")
def bidirectional_merge(spark, d):
    return corpora.both_directions(_pairs(spark, d))


@query("merge_all", f"{_BOTH} SELECT id, 'LANG_TOK_' || upper(src_lang) || ' ' || src AS src, 'LANG_TOK_' || upper(trg_lang) || ' ' || trg AS trg FROM b")
def merge_all(spark, d):
    return corpora.merged(bidirectional_merge(spark, d))


_DIRECTED = f"""{_BOTH}, k AS (SELECT *, row_number() OVER (PARTITION BY src_lang ORDER BY md5('1|' || id), id) AS k, count(*) OVER (PARTITION BY src_lang) AS n FROM b)
    SELECT id, src_lang, trg_lang, src, trg FROM k, unnest(range(1, 1 + CASE WHEN src_lang = 'en' THEN 2 + CASE WHEN k <= floor(n * 0.5) THEN 1 ELSE 0 END WHEN k <= floor(n * 0.3) THEN 1 ELSE 0 END)) AS t(c)"""


@query("merge_resampled", _DIRECTED)
def merge_resampled(spark, d):
    """Both directions of each pair, one repeated by its ratio, one sampled down."""
    return corpora.in_directions(_pairs(spark, d), ["en2de", "de2en"], {"en2de": 2.5, "de2en": 0.3})


# -- sampling -----------------------------------------------------------------

_BY_HASH = "r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('1|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query("downsample", f"WITH {_BY_HASH} SELECT doc_id, lang FROM r WHERE k <= floor(n * 0.3)")
def downsample(spark, d):
    return sampling.down_sample(table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), 0.3, by=["lang"])


@query("upsample", f"WITH {_BY_HASH} SELECT r.doc_id, r.lang, CAST(t.c AS INTEGER) AS copy FROM r, unnest(range(1, 3 + CASE WHEN k <= floor(n * 0.5) THEN 1 ELSE 0 END)) AS t(c)")
def upsample(spark, d):
    return sampling.up_sample(table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), 2.5, by=["lang"])


@query(
    "balance_langs",
    f"WITH {_BY_HASH}, m AS (SELECT max(n) AS most FROM r) SELECT r.doc_id, r.lang, CAST(t.c AS INTEGER) AS copy FROM r, m, unnest(range(1, CAST(1 + most // n + CASE WHEN k <= most % n THEN 1 ELSE 0 END AS BIGINT))) AS t(c)",
)
def balance_langs(spark, d):
    return sampling.balance(table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), "lang")


@query("paired_shuffle", f"WITH {_TURNS} SELECT conv_id, turn, row_number() OVER (ORDER BY md5('1|' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) AS place FROM p")
def paired_shuffle(spark, d):
    return sampling.shuffled(turns(spark, d).select("conv_id", "turn"), F.col("conv_id") * 1000 + F.col("turn"))


@query("shard_epoch", "SELECT doc_id FROM documents WHERE doc_id % 4 = 2")
def shard_epoch(spark, d):
    return sampling.shard(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 4, epoch=7)


@query("upsample_primary", "SELECT d.doc_id, CAST(t.c AS INTEGER) AS copy FROM documents d, unnest(range(1, CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 2 END)) AS t(c)")
def upsample_primary(spark, d):
    return sampling.repeat_primary(table(spark, d, "documents").select("doc_id"), F.col("doc_id") % 4 == 0, 3)


@query("length_buckets", "SELECT doc_id, CAST(ntile(8) OVER (ORDER BY n_chars, doc_id) AS INTEGER) AS bucket FROM documents")
def length_buckets(spark, d):
    """Eight buckets of equal size by length; ranks come from counts, so a frequent length isn't one task's."""
    rows = sampling.ranked_by(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    place, size, rest = F.col("rank") - 1, F.expr("total div 8"), F.expr("total % 8")
    first = rest * (size + 1)
    bucket = F.when(place < first, F.floor(place / (size + 1))).otherwise(rest + F.floor((place - first) / size))
    return rows.select("row.doc_id", (bucket + 1).cast("int").alias("bucket"))


# -- vocabularies -------------------------------------------------------------


def counts(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.word_counts(lines(spark, d), "line")


@query("word_count", f"WITH {_LINES}, {_TOKENS}, {_COUNTS} SELECT token, freq FROM c")
def word_count(spark, d):
    return counts(spark, d)


_CLEANED = _unescaped_sql("line")
_CLEAN_LINES = f"q AS (SELECT lang, regexp_replace(regexp_replace({_CLEANED}, '\\p{{C}}', ' ', 'g'), '[ ][ ]+', ' ', 'g') AS line FROM l)"


@query("vocab_topn", f"WITH {_LINES}, {_CLEAN_LINES}, {_TOKENS.replace('FROM l', 'FROM q')}, {_COUNTS} SELECT token, freq FROM c WHERE freq >= 5 ORDER BY freq DESC, token DESC LIMIT 1000")
def vocab_topn(spark, d):
    cleaned = cleaning.squeeze(cleaning.printable(cleaning.unescape(F.col("line"))))
    return vocabulary.cut(vocabulary.word_counts(lines(spark, d).select(cleaned.alias("line")), "line"), 5, 1000)


@query("vocab_cut", f"WITH {_LINES}, {_TOKENS}, {_COUNTS} SELECT token, freq FROM c WHERE freq >= 10")
def vocab_cut(spark, d):
    return vocabulary.cut(counts(spark, d), 10)


@query("vocab_lang_tokens", f"WITH {_LINES}, {_TOKENS}, {_COUNTS} SELECT token, freq FROM c WHERE freq >= 10 UNION ALL SELECT 'LANG_TOK_EN', -1 UNION ALL SELECT 'LANG_TOK_DE', -1")
def vocab_lang_tokens(spark, d):
    return vocabulary.with_language_tokens(vocab_cut(spark, d), ["en", "de"])


def _lang_counts(spark, d, lang: str) -> DataFrame:
    return vocabulary.word_counts(lines(spark, d).where(F.col("lang") == lang), "line")


_TWO = f"{_LINES}, {_TOKENS}, a AS (SELECT token, CAST(count(*) AS BIGINT) AS freq FROM w WHERE lang = 'en' AND length(token) > 0 GROUP BY token), b AS (SELECT token, CAST(count(*) AS BIGINT) AS freq FROM w WHERE lang = 'de' AND length(token) > 0 GROUP BY token)"


@query("vocab_anti", f"WITH {_TWO} SELECT token, freq FROM b WHERE token NOT IN (SELECT token FROM a)")
def vocab_anti(spark, d):
    return vocabulary.new_tokens(_lang_counts(spark, d, "en"), _lang_counts(spark, d, "de"))


@query("vocab_merge", f"WITH {_TWO} SELECT token, freq FROM a UNION ALL SELECT token, 20 FROM b WHERE token NOT IN (SELECT token FROM a)")
def vocab_merge(spark, d):
    return vocabulary.merged(_lang_counts(spark, d, "en"), _lang_counts(spark, d, "de"))


@query("vocab_total", f"WITH {_TWO} SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY token")
def vocab_total(spark, d):
    return vocabulary.total_counts(_lang_counts(spark, d, "en"), _lang_counts(spark, d, "de"))


@query("vocab_lines", f"WITH {_LINES}, {_TOKENS}, {_COUNTS} SELECT token || ' ' || freq AS line FROM c")
def vocab_lines(spark, d):
    return counts(spark, d).select(F.concat_ws(" ", "token", F.col("freq").cast("string")).alias("line"))


_SYMBOLS = f"""{_LINES}, {_TOKENS}, {_COUNTS}, s AS (
    SELECT freq, list_transform(range(1, length(token) + 1), lambda i: substr(token, i, 1) || CASE WHEN i = length(token) THEN '</w>' ELSE '' END) AS s FROM c WHERE length(token) > 1
), g AS (
    SELECT s.s[CAST(t.i AS INTEGER)] AS "left", s.s[CAST(t.i AS INTEGER) + 1] AS "right", CAST(sum(freq) AS BIGINT) AS freq FROM s, unnest(range(1, len(s.s))) AS t(i) GROUP BY ALL
)"""


@query("bpe_pair_stats", f'WITH {_SYMBOLS} SELECT "left", "right", freq FROM g')
def bpe_pair_stats(spark, d):
    return vocabulary.pair_counts(counts(spark, d))


@query("bpe_first_merge", f'WITH {_SYMBOLS} SELECT "left", "right", freq FROM g ORDER BY freq DESC, "left" DESC, "right" DESC LIMIT 1')
def bpe_first_merge(spark, d):
    return bpe_pair_stats(spark, d).orderBy(F.desc("freq"), F.desc("left"), F.desc("right")).limit(1)


#: The merges of the example configuration, and its least frequency of a vocabulary entry.
_MERGES, _LEAST = 600, 5
_LEARNED = f"""{_LINES}, {_TOKENS}, {_COUNTS}, b AS (
    SELECT 0 AS step, token, freq, array_to_string(list_transform(range(1, length(token) + 1), lambda i: ' ' || substr(token, i, 1) || CASE WHEN i = length(token) THEN '</w>' ELSE '' END || ' '), '') AS s, '' AS x, '' AS y FROM c
    UNION ALL
    SELECT b.step + 1, b.token, b.freq, replace(b.s, ' ' || m.x || '  ' || m.y || ' ', ' ' || m.x || m.y || ' '), m.x, m.y
    FROM b, (SELECT x, y FROM (SELECT freq, unnest(q[:-2]) AS x, unnest(q[2:]) AS y FROM (SELECT freq, string_split(substr(s, 2, length(s) - 2), '  ') AS q FROM b) WHERE len(q) > 1) GROUP BY ALL HAVING sum(freq) >= 2 ORDER BY sum(freq) DESC, x DESC, y DESC LIMIT 1) m
    WHERE b.step < {_MERGES}
), mg AS (SELECT step - 1 AS rank, any_value(x) AS x, any_value(y) AS y FROM b WHERE step > 0 GROUP BY step),
fin AS (SELECT token, freq, string_split(substr(s, 2, length(s) - 2), '  ') AS ps FROM b WHERE step = (SELECT max(step) FROM b)),
pc AS (SELECT token, freq, list_transform(ps, lambda q: CASE WHEN q LIKE '%</w>' THEN substr(q, 1, length(q) - 4) ELSE q || '@@' END) AS ps FROM fin)"""
_CODED = "SELECT l.doc_id, l.line_no, coalesce(string_agg(array_to_string(e.ps, ' '), ' ' ORDER BY t.i), '') AS text FROM (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda q: length(q) > 0) AS ts FROM l) l LEFT JOIN unnest(range(1, len(l.ts) + 1)) AS t(i) ON TRUE LEFT JOIN {0} e ON e.token = l.ts[CAST(t.i AS INTEGER)] GROUP BY ALL"


def _learned(spark, d) -> list[tuple[str, str]]:
    return vocabulary.learn_merges(counts(spark, d), _MERGES)


@query("bpe_learn", f'WITH RECURSIVE {_LEARNED} SELECT CAST(rank AS INTEGER) AS rank, x AS "left", y AS "right" FROM mg')
def bpe_learn(spark, d):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_learned(spark, d))], "rank int, left string, right string")


@query("bpe_encode", f"WITH RECURSIVE {_LEARNED} {_CODED.format('pc')}")
def bpe_encode(spark, d):
    return vocabulary.encode(lines(spark, d), ["doc_id", "line_no"], "line", _learned(spark, d)).select("doc_id", "line_no", F.array_join("pieces", " ").alias("text"))


_PIECES = f"{_LEARNED}, vo AS (SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(ps) AS token, freq FROM pc) GROUP BY token)"


@query("bpe_vocabulary", f"WITH RECURSIVE {_PIECES} SELECT token, freq FROM vo WHERE freq >= {_LEAST}")
def bpe_vocabulary(spark, d):
    """The pieces of the encoded corpus, counted over distinct words; the words themselves are counted once."""
    words = corpus.settled(counts(spark, d))
    return vocabulary.cut(vocabulary.piece_counts(words, vocabulary.learn_merges(words, _MERGES)), _LEAST)


@query(
    "bpe_vocab_encode",
    f"""WITH RECURSIVE {_PIECES}, ok AS (SELECT token FROM vo WHERE freq >= 1000),
    hv AS (SELECT x || y AS piece, arg_min(x, rank) AS x, arg_min(y, rank) AS y FROM mg GROUP BY ALL),
    sp AS (
        SELECT token, lpad(CAST(i.i AS VARCHAR), 6, '0') AS place, ps[CAST(i.i AS INTEGER)] AS p, 0 AS depth FROM fin, unnest(range(1, len(ps) + 1)) AS i(i)
        UNION ALL
        SELECT sp.token, sp.place || CASE WHEN k.k = 0 THEN '0' ELSE '1' END, CASE WHEN k.k = 0 THEN hv.x ELSE hv.y END, sp.depth + 1
        FROM sp JOIN hv ON hv.piece = sp.p, (SELECT unnest([0, 1]) AS k) k
        WHERE CASE WHEN sp.p LIKE '%</w>' THEN substr(sp.p, 1, length(sp.p) - 4) ELSE sp.p || '@@' END NOT IN (SELECT token FROM ok)
    ),
    le AS (SELECT token, list(CASE WHEN p LIKE '%</w>' THEN substr(p, 1, length(p) - 4) ELSE p || '@@' END ORDER BY place) AS ps FROM sp
        WHERE CASE WHEN p LIKE '%</w>' THEN substr(p, 1, length(p) - 4) ELSE p || '@@' END IN (SELECT token FROM ok) OR p NOT IN (SELECT piece FROM hv) GROUP BY token)
    {_CODED.format('le')}""",
)
def bpe_vocab_encode(spark, d):
    """Pieces that occur fewer than 1,000 times are split back along the merges."""
    words = corpus.settled(counts(spark, d))
    merges = vocabulary.learn_merges(words, _MERGES)
    allowed = {r.token for r in vocabulary.cut(vocabulary.piece_counts(words, merges), 1000).select("token").collect()}  # at most a piece a merge and character
    return vocabulary.encode(lines(spark, d), ["doc_id", "line_no"], "line", merges, allowed).select("doc_id", "line_no", F.array_join("pieces", " ").alias("text"))


@query("glossary_isolate", f"WITH {_LINES} SELECT doc_id, line_no, trim(regexp_replace(replace(line, 'the', ' the '), ' +', ' ', 'g')) AS text FROM l")
def glossary_isolate(spark, d):
    words = tokenizing.isolate(tokenizing.tokens(F.col("line")), ["the"])
    return lines(spark, d).select("doc_id", "line_no", F.array_join(words, " ").alias("text"))


# -- lexicons -----------------------------------------------------------------

_PSEUDO = f"""{_LINES}, {_TOKENS}, f AS (SELECT lang, token, count(*) AS n FROM w WHERE length(token) > 0 GROUP BY ALL),
    k AS (SELECT lang, token, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS INTEGER) AS rank FROM f),
    x AS (SELECT b.lang, a.token AS src_word, b.token AS trg_word, a.rank FROM k a JOIN k b ON a.rank = b.rank AND a.lang = 'en' AND b.lang <> 'en')"""


def _words_of_languages(spark, d) -> DataFrame:
    return lines(spark, d).select("lang", F.explode(tokenizing.tokens(F.col("line"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


def ranked_words(spark, d) -> DataFrame:
    """(lang, token, rank) of every word by falling count, then word; ranks come from counts of groups of words, so no task holds a language."""
    words = _words_of_languages(spark, d).withColumn("head", F.substring("token", 1, 3))
    sizes = words.groupBy("lang", "n", "head").agg(F.count("*").alias("m"))
    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upper = sizes.groupBy("lang", "n").agg(F.sum("m").alias("m")).select("lang", "n", before(W.partitionBy("lang").orderBy(F.desc("n"))).alias("upper"))
    lower = sizes.select("lang", "n", "head", before(W.partitionBy("lang", "n").orderBy("head")).alias("lower"))
    bases = lower.join(F.broadcast(upper), ["lang", "n"])
    within = F.row_number().over(W.partitionBy("lang", "n", "head").orderBy("token"))
    rows = words.withColumn("within", within).join(bases, ["lang", "n", "head"])
    return rows.select("lang", "token", (F.col("upper") + F.col("lower") + F.col("within")).cast("int").alias("rank"))


def pseudo_lexicon(spark, d) -> DataFrame:
    """(lang, src_word, trg_word, rank): words of equal frequency rank."""
    target = F.when(F.col("lang") != "en", F.struct("lang", F.col("token").alias("trg_word")))
    alike = ranked_words(spark, d).groupBy("rank").agg(F.max(F.when(F.col("lang") == "en", F.col("token"))).alias("src_word"), F.collect_list(target).alias("targets"))
    pairs = alike.where("src_word is not null").select("src_word", "rank", F.explode("targets").alias("t"))
    return pairs.select("t.lang", "src_word", "t.trg_word", "rank")


@query("lexicon_cap", f"WITH {_PSEUDO} SELECT lang, src_word, trg_word, rank FROM x WHERE rank <= 101")
def lexicon_cap(spark, d):
    return corpus.capped(pseudo_lexicon(spark, d), 100, ["lang"])


@query("lexicon_group", f"WITH {_PSEUDO} SELECT lang, substr(src_word, 1, 2) AS src_word, string_agg(trg_word, ' ' ORDER BY rank, trg_word) AS words FROM x GROUP BY ALL")
def lexicon_group(spark, d):
    e = pseudo_lexicon(spark, d).withColumn("src_word", F.substring("src_word", 1, 2))
    return lexicon.grouped(e).select("lang", "src_word", F.array_join("trg_words", " ").alias("words"))


@query("multi_lexicon_parse", f"WITH {_PSEUDO} SELECT 'en' AS src_lang, src_word, lang AS trg_lang, trg_word, 1 + rank % 3 AS depth FROM x")
def multi_lexicon_parse(spark, d):
    cell = F.concat(F.upper("lang"), F.lit("__"), F.col("trg_word"), F.lit("__"), (1 + F.col("rank") % 3).cast("string"))
    rows = pseudo_lexicon(spark, d).groupBy("src_word").agg(F.concat_ws("\t", F.concat(F.lit("EN__"), F.first("src_word")), F.collect_list(cell)).alias("line"))
    return corpus.multi_lexicon(rows, "line", ["en"])


@query("lexicon_unknown_rate", f"WITH {_PSEUDO} SELECT w.lang, round(sum(CASE WHEN y.src_word IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS unknown FROM w LEFT JOIN (SELECT DISTINCT src_word FROM x) y ON w.token = y.src_word WHERE length(w.token) > 0 GROUP BY w.lang")
def lexicon_unknown_rate(spark, d):
    words = _words_of_languages(spark, d).withColumnRenamed("token", "src_word")
    known = pseudo_lexicon(spark, d).select("src_word", F.lit(1).alias("k")).distinct()
    return words.join(known, "src_word", "left").groupBy("lang").agg(F.round(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unknown"))


_EDGES = f"{_PSEUDO}, e AS (SELECT a.lang || ':' || a.token AS a, b.lang || ':' || b.token AS b FROM k a JOIN k b ON a.rank = b.rank AND a.lang < b.lang), u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e))"


def word_edges(spark, d) -> DataFrame:
    """Words of equal rank in any two languages: the lexicons from English and those between the others."""
    alike = ranked_words(spark, d).groupBy("rank").agg(F.collect_list(F.concat("lang", F.lit(":"), "token")).alias("words"))
    return alike.select("words", F.explode("words").alias("a")).select("a", F.explode("words").alias("b")).where("a < b")


@query("word_graph_edges", f"WITH {_EDGES} SELECT a, b FROM u")
def word_graph_edges(spark, d):
    return lexicon.undirected(word_edges(spark, d))


@query("khop_neighbors", f"WITH RECURSIVE {_EDGES}, h AS (SELECT a AS src, b AS dst, 1 AS depth FROM u UNION ALL SELECT h.src, u.b, h.depth + 1 FROM h JOIN u ON h.dst = u.a WHERE h.depth < 3) SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM h WHERE src <> dst GROUP BY src, dst")
def khop_neighbors(spark, d):
    return lexicon.neighbours(word_edges(spark, d), 3)


@query("multi_lexicon_lines", f"WITH RECURSIVE {_EDGES}, h AS (SELECT a AS src, b AS dst, 1 AS depth FROM u UNION ALL SELECT h.src, u.b, h.depth + 1 FROM h JOIN u ON h.dst = u.a WHERE h.depth < 3), m AS (SELECT src, dst, min(depth) AS depth FROM h WHERE src <> dst GROUP BY src, dst) SELECT src, src || chr(9) || string_agg(dst || '__' || depth, chr(9) ORDER BY depth, dst || '__' || depth) AS line FROM m GROUP BY src")
def multi_lexicon_lines(spark, d):
    return lexicon.adjacency_lines(khop_neighbors(spark, d))


_REACH = f"{_EDGES}, r AS (SELECT a AS id, a AS to_ FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_ = u.a)"


@query("components", f"WITH RECURSIVE {_REACH} SELECT id, min(to_) AS component FROM r GROUP BY id")
def components(spark, d):
    return lexicon.components(word_edges(spark, d))


@query("component_max", f"WITH RECURSIVE {_REACH}, c AS (SELECT id, min(to_) AS component FROM r GROUP BY id), z AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT CAST(count(*) AS BIGINT) AS groups, CAST(max(n) AS BIGINT) AS most FROM z")
def component_max(spark, d):
    return components(spark, d).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("most"))


_PROB = int(0.15 * lexicon.SPACE)
_RAS = f"""{_PSEUDO}, i AS (SELECT doc_id * 100000 + line_no AS id, list_filter(string_split(line, ' '), lambda q: length(q) > 0) AS tokens FROM l),
    ch AS (SELECT id, tokens, lang FROM (SELECT id, tokens, lang, row_number() OVER (PARTITION BY id ORDER BY md5('1|' || id || '|' || lang), lang) AS n FROM i, (SELECT unnest(['de', 'es', 'fr']) AS lang)) WHERE n <= {{copies}}),
    tk AS (SELECT ch.id, ch.lang, CAST(t.p AS INTEGER) AS pos, ch.tokens[CAST(t.p AS INTEGER) + 1] AS token FROM ch, unnest(range(len(ch.tokens))) AS t(p)),
    rp AS (SELECT tk.id, tk.lang, tk.pos, tk.token, arg_min(x.trg_word, md5('1|c|' || tk.id || '|' || tk.lang || '|' || tk.pos || '|' || x.rank)) AS word
        FROM tk LEFT JOIN x ON x.lang = tk.lang AND x.src_word = tk.token AND {_sql_draw("'1'", "'p'", 'tk.id', 'tk.lang', 'tk.pos')} < {_PROB} GROUP BY ALL),
    rs AS (SELECT id, lang, string_agg(coalesce(word, token), ' ' ORDER BY pos) AS text, CAST(sum(CASE WHEN word IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS replaced, CAST(count(*) AS BIGINT) AS total FROM rp GROUP BY id, lang)"""


def _substituted(spark, d, copies: int = 1) -> DataFrame:
    rows = lines(spark, d).select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), tokenizing.tokens(F.col("line")).alias("tokens"))
    return lexicon.substitute(rows, pseudo_lexicon(spark, d), ["de", "es", "fr"], 0.15, copies)


@query("ras_bilingual", f"WITH {_RAS.format(copies=1)} SELECT id, lang, text, replaced FROM rs WHERE replaced > 0")
def ras_bilingual(spark, d):
    return lexicon.augmented(_substituted(spark, d)).select("id", "lang", F.array_join("tokens", " ").alias("text"), "replaced")


_CAP = 2000
_CAPPED = _RAS.replace("AND a.lang = 'en' AND b.lang <> 'en')", f"AND a.lang = 'en' AND b.lang <> 'en' AND a.rank <= {_CAP + 1})")


@query("ras_capped", f"WITH {_CAPPED.format(copies=1)} SELECT id, lang, text, replaced FROM rs WHERE replaced > 0")
def ras_capped(spark, d):
    """With the default cap of a lexicon, which every worker holds."""
    rows = lines(spark, d).select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), tokenizing.tokens(F.col("line")).alias("tokens"))
    entries = corpus.capped(pseudo_lexicon(spark, d).where(F.col("rank") <= _CAP + 1), _CAP, ["lang"])
    found = lexicon.substitute(rows, entries, ["de", "es", "fr"], 0.15, most=3 * (_CAP + 1))
    return lexicon.augmented(found).select("id", "lang", F.array_join("tokens", " ").alias("text"), "replaced")


@query("ras_repeat", f"WITH {_RAS.format(copies=2)} SELECT id, lang, replaced, total FROM rs")
def ras_repeat(spark, d):
    return _substituted(spark, d, 2).select("id", "lang", "replaced", "total")


@query("ras_stats", f"WITH {_RAS.format(copies=1)} SELECT CAST(sum(total) AS BIGINT) AS total_tokens, CAST(sum(replaced) AS BIGINT) AS replaced_tokens, round(100 * sum(replaced) / sum(total), 6) AS percent FROM rs")
def ras_stats(spark, d):
    return lexicon.statistics(_substituted(spark, d))


@query("augment_union", f"WITH {_RAS.format(copies=1)} SELECT id, array_to_string(tokens, ' ') AS text FROM i UNION ALL SELECT id, text FROM rs WHERE replaced > 0")
def augment_union(spark, d):
    rows = lines(spark, d).select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), F.array_join(tokenizing.tokens(F.col("line")), " ").alias("text"))
    return rows.unionByName(ras_bilingual(spark, d).select("id", "text"))


_MULTI = f"""{_PSEUDO}, m AS (SELECT src_word, lang AS trg_lang, trg_word, 1 + rank % 2 AS depth FROM x),
    md AS (SELECT src_word, least(count(DISTINCT depth), 2) AS md FROM m GROUP BY src_word),
    wt AS (SELECT m.src_word, m.trg_word, m.trg_lang || '~' || m.trg_word || '~' || t.w AS rank FROM m JOIN md ON m.src_word = md.src_word AND m.depth <= md.md, unnest(range(1, 1 + CAST(pow(2, md.md - m.depth) AS BIGINT))) AS t(w) WHERE m.trg_lang IN ('de', 'fr')),
    tk AS (SELECT d.id, CAST(t.p AS INTEGER) AS pos, d.tokens[CAST(t.p AS INTEGER) + 1] AS token FROM (SELECT doc_id * 100000 + line_no AS id, list_filter(string_split(line, ' '), lambda q: length(q) > 0) AS tokens FROM l WHERE lang = 'en') d, unnest(range(len(d.tokens))) AS t(p)),
    rp AS (SELECT tk.id, tk.pos, tk.token, arg_min(wt.trg_word, md5('1|c|' || tk.id || '|1|' || tk.pos || '|' || wt.rank)) AS word FROM tk LEFT JOIN wt ON wt.src_word = tk.token AND {_sql_draw("'1'", "'p'", 'tk.id', "'1'", 'tk.pos')} < {_PROB} GROUP BY ALL)"""


@query("ras_multi", f"WITH {_MULTI} SELECT id, string_agg(coalesce(word, token), ' ' ORDER BY pos) AS text, CAST(sum(CASE WHEN word IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS replaced FROM rp GROUP BY id")
def ras_multi(spark, d):
    rows = lines(spark, d).where("lang = 'en'").select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), F.lit("en").alias("src_lang"), tokenizing.tokens(F.col("line")).alias("tokens"))
    e = pseudo_lexicon(spark, d).select(F.lit("en").alias("src_lang"), "src_word", F.col("lang").alias("trg_lang"), "trg_word", (1 + F.col("rank") % 2).alias("depth"))
    return lexicon.substitute_multi(rows, e, ["de", "fr"], max_depth=2).select("id", F.array_join("tokens", " ").alias("text"), "replaced")


# -- evaluation ---------------------------------------------------------------

_LOG = "g AS (SELECT conv_id * 1000 + turn AS id, role, text, turn, CASE WHEN role = 'assistant' THEN 'H-' || (conv_id * 1000 + turn) || chr(9) || CASE WHEN turn % 2 = 0 THEN '-1' ELSE '-0.' || (turn + 11) END || chr(9) || text || ' T-34' ELSE 'S-' || (conv_id * 1000 + turn) || chr(9) || text END AS line FROM conversations)"


def decoder_lines(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    score = F.when(F.col("turn") % 2 == 0, F.lit("-1")).otherwise(F.concat(F.lit("-0."), (F.col("turn") + 11).cast("string")))
    hyp = F.concat(F.lit("H-"), key, F.lit("\t"), score, F.lit("\t"), F.col("text"), F.lit(" T-34"))
    return c.select(F.when(F.col("role") == "assistant", hyp).otherwise(F.concat(F.lit("S-"), key, F.lit("\t"), F.col("text"))).alias("line"))


@query("genlog_parse", f"WITH {_LOG} SELECT CASE WHEN role = 'assistant' THEN 'H' ELSE 'S' END AS line_type, id, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 2 = 0 THEN -1.0 ELSE CAST('-0.' || (turn + 11) AS DOUBLE) END END AS score, CASE WHEN role = 'assistant' THEN text || ' T-34' ELSE text END AS text FROM g")
def genlog_parse(spark, d):
    return corpus.generation_log(decoder_lines(spark, d), "line")


@query("genlog_grep", f"WITH {_LOG} SELECT line FROM g WHERE regexp_matches(line, '^[SHPT]-[0-9]+')")
def genlog_grep(spark, d):
    return decoder_lines(spark, d).where(F.col("line").rlike("^[SHPT]-[0-9]+"))


@query("hyp_ref_join", f"WITH {_LOG} SELECT h.id, h.text || ' T-34' AS hyp, r.text AS ref FROM g h JOIN g r ON r.id = h.id - 1 AND r.role = 'user' WHERE h.role = 'assistant'")
def hyp_ref_join(spark, d):
    log = genlog_parse(spark, d)
    h = log.where("line_type = 'H'").select("id", F.col("text").alias("hyp"))
    r = log.where("line_type = 'S'").join(table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")), "id", "left_semi")
    return h.join(r.select((F.col("id") + 1).alias("id"), F.col("text").alias("ref")), "id")


@query("nbest_rank", "SELECT conv_id AS id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') WHERE n = 2")
def nbest_rank(spark, d):
    log = table(spark, d, "conversations").where("role = 'assistant'").select(F.lit("H").alias("line_type"), F.col("conv_id").alias("id"), "turn", "text")
    return evaluation.ranked_hypotheses(log, "turn", rank=1).select("id", "text")


@query("nbest_lists", "SELECT conv_id AS id, string_agg(text, ' ||| ' ORDER BY turn) AS hyps, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def nbest_lists(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    lists = c.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"), F.count("*").alias("n"))
    return lists.select("id", F.array_join("l.text", " ||| ").alias("hyps"), "n")


_WORDS = "list_filter(string_split({0}, ' '), lambda q: length(q) > 0)"


def _grams(src: str, trg: str) -> str:
    return f"""{_TURNS}, t AS (SELECT conv_id * 1000 + turn AS id, {_WORDS.format(src)} AS h, {_WORDS.format(trg)} AS r FROM p),
    hg AS (SELECT t.id, n.n, array_to_string(t.h[CAST(i.i AS INTEGER):CAST(i.i + n.n - 1 AS INTEGER)], ' ') AS g, count(*) AS c FROM t, (SELECT unnest(range(1, 5)) AS n) n, unnest(range(1, len(t.h) - n.n + 2)) AS i(i) GROUP BY ALL),
    rg AS (SELECT t.id, n.n, array_to_string(t.r[CAST(i.i AS INTEGER):CAST(i.i + n.n - 1 AS INTEGER)], ' ') AS g, count(*) AS c FROM t, (SELECT unnest(range(1, 5)) AS n) n, unnest(range(1, len(t.r) - n.n + 2)) AS i(i) GROUP BY ALL),
    o AS (SELECT hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS m, sum(hg.c) AS t FROM hg LEFT JOIN rg ON hg.id = rg.id AND hg.n = rg.n AND hg.g = rg.g GROUP BY hg.n),
    bs AS (SELECT {', '.join(f'CAST(coalesce(sum(CASE WHEN n = {n} THEN {a} END), 0) AS BIGINT) AS {b}{n}' for a, b in (('m', 'match'), ('t', 'total')) for n in range(1, 5))}, (SELECT CAST(sum(len(h)) AS BIGINT) FROM t) AS hyp_len, (SELECT CAST(sum(len(r)) AS BIGINT) FROM t) AS ref_len FROM o)"""


_GRAMS = _grams("src", "trg")
_COLUMNS = ", ".join([f"{a}{n}" for a in ("match", "total") for n in range(1, 5)] + ["hyp_len", "ref_len"])


def _bleu_stats(spark, d) -> DataFrame:
    rows = turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tokenizing.tokens(F.col("src")).alias("hyp"), tokenizing.tokens(F.col("trg")).alias("ref"))
    return evaluation.bleu_statistics(rows)


@query("bleu_stats", f"WITH {_GRAMS} SELECT {_COLUMNS} FROM bs")
def bleu_stats(spark, d):
    return _bleu_stats(spark, d)


_P = [f"CASE WHEN total{n} = 0 THEN 0 WHEN match{n} = 0 THEN 1.0 / (pow(2, {' + '.join(f'(CASE WHEN match{k} = 0 THEN 1 ELSE 0 END)' for k in range(1, n + 1))}) * total{n}) ELSE match{n} / total{n} END" for n in range(1, 5)]


def _bleu_sql(grams: str) -> str:
    return f"WITH {grams}, pr AS (SELECT {', '.join(f'{p} AS p{n}' for n, p in enumerate(_P, 1))}, hyp_len, ref_len FROM bs) SELECT round(100 * CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1 END * CASE WHEN least(p1, p2, p3, p4) > 0 THEN exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 2) AS bleu FROM pr"


@query("corpus_bleu", _bleu_sql(_GRAMS))
def corpus_bleu(spark, d):
    return evaluation.bleu(_bleu_stats(spark, d)).select("bleu")


_SCORES = "s AS (SELECT date_trunc('second', ts) AS ts, 'checkpoint_' || user_id AS ckpt, event_type AS testset, round(value, 4) AS score, event_id FROM events WHERE value IS NOT NULL), la AS (SELECT ts, ckpt, testset, score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ckpt, testset ORDER BY ts DESC, event_id) AS n FROM s) WHERE n = 1)"


def score_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("checkpoint_"), F.col("user_id").cast("string")), "event_type", F.round("value", 4).cast("string"))
    return corpus.score_log(e.select("event_id", line.alias("line")), "line")


@query("latest_score", f"WITH {_SCORES} SELECT ts, ckpt, testset, score FROM la")
def latest_score(spark, d):
    return evaluation.latest_scores(score_rows(spark, d), "event_id").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "ckpt", "testset", "score")


def _ranking(spark, d, k: int) -> DataFrame:
    return evaluation.ranked_checkpoints(evaluation.latest_scores(score_rows(spark, d), "event_id"), "click", k)


_RANKED = f"WITH {_SCORES}, rk AS (SELECT ckpt, score, CAST(regexp_extract(ckpt, '([0-9]+)$', 1) AS BIGINT) AS number FROM la WHERE testset = 'click')"


@query("ckpt_topk", f"{_RANKED} SELECT ckpt, score, number FROM rk ORDER BY score DESC, number DESC LIMIT 5")
def ckpt_topk(spark, d):
    return _ranking(spark, d, 5)


@query("ckpt_evict", f"{_RANKED} SELECT ckpt, score, number FROM (SELECT * FROM rk ORDER BY score DESC, number DESC LIMIT 6) ORDER BY score, number LIMIT 1")
def ckpt_evict(spark, d):
    return evaluation.to_evict(_ranking(spark, d, 6), 5)


@query("newest_ckpts", "SELECT DISTINCT 'checkpoint' || user_id || '.pt' AS name, user_id AS step FROM events WHERE user_id <= 100 ORDER BY step DESC LIMIT 7")
def newest_ckpts(spark, d):
    names = table(spark, d, "events").select(F.concat(F.lit("checkpoint"), F.col("user_id").cast("string"), F.lit(".pt")).alias("name")).distinct()
    return corpus.checkpoints(names, "name", 7, upper_bound=100)


def _parameters(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").alias("ckpt"), F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string")).alias("param"), F.posexplode("embedding").alias("pos", "value"))


@query("param_average", "SELECT 'p' || (vec_id % 5) AS param, CAST(i.i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[CAST(i.i AS INTEGER)] AS DOUBLE)), 6) AS value FROM embeddings, unnest(range(1, 65)) AS i(i) GROUP BY ALL")
def param_average(spark, d):
    return evaluation.averaged(_parameters(spark, d)).select("param", "pos", F.round("value", 6).alias("value"))


@query("param_key_check", "WITH k AS (SELECT label, string_agg(DISTINCT 'p' || (vec_id % 5), ',' ORDER BY 'p' || (vec_id % 5)) AS s FROM embeddings GROUP BY label) SELECT CAST(count(*) AS BIGINT) AS checkpoints, CAST(count(DISTINCT s) AS BIGINT) AS kinds, count(DISTINCT s) <= 1 AS equal FROM k")
def param_key_check(spark, d):
    return evaluation.same_parameters(_parameters(spark, d).select("ckpt", "param"))


@query("mean_pool_masked", "SELECT label, CAST(i.i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[CAST(i.i AS INTEGER)] AS DOUBLE)), 6) AS value FROM embeddings, unnest(range(1, 65)) AS i(i) WHERE vec_id % 3 <> 0 GROUP BY ALL")
def mean_pool_masked(spark, d):
    e = table(spark, d, "embeddings").select("label", "embedding", "vec_id")
    return evaluation.pooled(e, ["label"], "embedding", (F.col("vec_id") % 3 != 0).cast("int")).select("label", "pos", F.round("value", 6).alias("value"))


_COSINE = "n AS (SELECT a.vec_id AS src_id, b.vec_id AS trg_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1), nr AS (SELECT src_id, trg_id, sim, CAST(row_number() OVER (PARTITION BY src_id ORDER BY sim DESC, trg_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 5)"


def _neighbours(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return evaluation.nearest(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 5)


@query("cosine_topk", f"WITH {_COSINE} SELECT src_id, trg_id, round(sim, 6) AS similarity, rank FROM nr")
def cosine_topk(spark, d):
    return _neighbours(spark, d).select("src_id", "trg_id", F.round(F.round("similarity", 9), 6).alias("similarity"), "rank")


@query("retrieval_accuracy", f"WITH {_COSINE} SELECT round(sum(CASE WHEN src_id // 2 = trg_id // 2 AND rank <= 1 THEN 1 ELSE 0 END) / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1), 6) AS top1, round(sum(CASE WHEN src_id // 2 = trg_id // 2 THEN 1 ELSE 0 END) / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1), 6) AS top5 FROM nr")
def retrieval_accuracy(spark, d):
    n = table(spark, d, "embeddings").where("vec_id % 2 = 1").count()
    return evaluation.retrieval_accuracy(_neighbours(spark, d), n, F.expr("src_id div 2 = trg_id div 2"))


@query("corpus_bleu_13a", _bleu_sql(_grams(_public_tokens("src"), _public_tokens("trg"))))
def corpus_bleu_13a(spark, d):
    """Corpus BLEU over the public tokenisation of both sides."""
    side = lambda c: tokenizing.tokens(tokenizing.tokenize_bleu(F.col(c)))
    rows = turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), side("src").alias("hyp"), side("trg").alias("ref"))
    return evaluation.bleu(evaluation.bleu_statistics(rows)).select("bleu")


_MATRIX = "m AS (SELECT a.vec_id % 3 AS s, b.vec_id % 3 AS t, a.vec_id // 3 AS i, b.vec_id // 3 AS j, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 3 <> b.vec_id % 3), mr AS (SELECT s, t, i, j, row_number() OVER (PARTITION BY s, t, i ORDER BY sim DESC, j) AS k FROM m QUALIFY k <= 5)"


@query("retrieval_matrix", f"WITH {_MATRIX} SELECT 'l' || s AS src_lang, 'l' || t AS trg_lang, round(sum(CASE WHEN i = j AND k = 1 THEN 1 ELSE 0 END) / (SELECT count(*) FROM embeddings WHERE vec_id % 3 = t), 6) AS top1, round(sum(CASE WHEN i = j THEN 1 ELSE 0 END) / (SELECT count(*) FROM embeddings WHERE vec_id % 3 = t), 6) AS top5 FROM mr GROUP BY s, t")
def retrieval_matrix(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("l"), (F.col("vec_id") % 3).cast("string")).alias("lang"), F.expr("vec_id div 3").alias("id"), F.col("embedding").alias("vec"))
    return evaluation.retrieval_matrix(rows, ["l0", "l1", "l2"])


_FOLDERS = "f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'en_de' WHEN 1 THEN 'en2fr' ELSE 'en-es' END AS folder FROM documents)"


@query("pair_folders", f"WITH {_FOLDERS} SELECT doc_id, folder FROM f WHERE regexp_matches(folder, '^[a-z][a-z](_|2)[a-z][a-z]$')")
def pair_folders(spark, d):
    k = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select("doc_id", F.when(k == 0, "en_de").when(k == 1, "en2fr").otherwise("en-es").alias("folder"))
    return rows.where(monitor.pair_folder(F.col("folder")))


@query("post_command", "SELECT conv_id, turn, replace('LANG_TOK_DE ' || text, 'LANG_TOK_DE ', '') AS text FROM conversations")
def post_command(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace(F.concat(F.lit("LANG_TOK_DE "), F.col("text")), F.lit("LANG_TOK_DE "), F.lit("")).alias("text"))


# -- datasets -----------------------------------------------------------------

_IDS = f"v AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token DESC) + 3 AS BIGINT) AS id FROM (SELECT * FROM c ORDER BY freq DESC, token DESC LIMIT 1000)), ti AS (SELECT doc_id, i.i AS pos, coalesce(v.id, 3) AS id FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda q: length(q) > 0) AS t FROM documents) d, unnest(range(1, len(d.t) + 1)) AS i(i) LEFT JOIN v ON v.token = d.t[CAST(i.i AS INTEGER)])"


def _ids(spark, d) -> DataFrame:
    vocab = vocabulary.cut(counts(spark, d), 0, 1000)
    ids = vocab.withColumn("id", (F.row_number().over(W.orderBy(F.desc("freq"), F.desc("token"))) + 3).cast("bigint")).select("token", "id")
    rows = table(spark, d, "documents").select("doc_id", tokenizing.tokens(F.col("text")).alias("pieces")).where("size(pieces) > 0")
    return vocabulary.token_ids(rows, ["doc_id"], "pieces", ids, 3)


@query("token_ids", f"WITH {_LINES}, {_TOKENS}, {_COUNTS}, {_IDS} SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM ti GROUP BY doc_id")
def token_ids(spark, d):
    return _ids(spark, d).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("truncate_eos", f"WITH {_LINES}, {_TOKENS}, {_COUNTS}, {_IDS}, x AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM ti GROUP BY doc_id) SELECT doc_id, array_to_string(list_append(ids[1:99], 2), ' ') AS ids FROM x")
def truncate_eos(spark, d):
    return _ids(spark, d).select("doc_id", F.array_join(corpora.with_eos(F.col("ids"), 2, 100).cast("array<string>"), " ").alias("ids"))


@query("prepend_bos", f"WITH {_LINES}, {_TOKENS}, {_COUNTS}, {_IDS} SELECT doc_id, '0 ' || string_agg(id, ' ' ORDER BY pos) AS ids FROM ti GROUP BY doc_id")
def prepend_bos(spark, d):
    return _ids(spark, d).select("doc_id", F.array_join(F.concat(F.array(F.lit(0).cast("bigint")), "ids").cast("array<string>"), " ").alias("ids"))


@query("size_filter", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda q: length(q) > 0)) <= 256")
def size_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tokenizing.tokens(F.col("text")).alias("t"))
    return corpora.fits(rows, "t", 256).select("doc_id")


@query("unknown_apart", f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(list_transform(string_split(src, ' '), lambda q: CASE WHEN length(q) > 6 THEN 'UNKNOWNTOKENINHYP' ELSE q END), ' ') AS hyp FROM p")
def unknown_apart(spark, d):
    words = F.transform(F.split("src", " "), lambda w: F.when(F.length(w) > 6, F.lit("<unk>")).otherwise(w))
    return turns(spark, d).select("conv_id", "turn", F.array_join(evaluation.unknown_apart(words, False), " ").alias("hyp"))


_KIND_OF = "CASE lower(f[i]) WHEN 'the' THEN 'DET' WHEN 'and' THEN 'CON' ELSE 'PN' END"
_NUMBER_OF = "len(list_filter(f[:i - 1], lambda z: CASE lower(z) WHEN 'the' THEN 'DET' WHEN 'and' THEN 'CON' ELSE 'PN' END = " + _KIND_OF + "))"


@query(
    "entity_placeholder",
    f"""WITH {_LINES}, f AS (SELECT doc_id, line_no, lang, regexp_extract_all(line, '(?i)thread|the|and') AS f, string_split_regex(line, '(?i)thread|the|and') AS g FROM l)
    SELECT doc_id, line_no, lang, g[1] || array_to_string(list_transform(range(1, len(f) + 1), lambda i: '<--plhd-' || {_KIND_OF} || '-' || {_NUMBER_OF} || '/>' || g[i + 1]), '') AS text,
        array_to_string(list_transform(f, lambda z: CASE lower(z) WHEN 'the' THEN 'le' WHEN 'and' THEN 'et' ELSE 'fil' END), ' ') AS entities FROM f""",
)
def entity_placeholder(spark, d):
    names = [("the", "le", "DET"), ("and", "et", "CON"), ("thread", "fil", "")]
    return evaluation.placed(lines(spark, d).select("doc_id", "line_no", "lang", "line"), "line", names).withColumn("entities", F.array_join("entities", " "))


_PATHS = "f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/m/checkpoint_' || doc_id || '.pt' WHEN 1 THEN '/m/checkpoint_best.pt' WHEN 2 THEN '/m/a__b.txt' ELSE '/m/x.log' END AS path FROM documents)"


@query("event_file_filter", f"WITH {_PATHS} SELECT doc_id, doc_id % 4 = 0 AS ckpt, doc_id % 4 = 2 AS result, replace(path, '__', '/') AS name FROM f")
def event_file_filter(spark, d):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/m/checkpoint_"), F.col("doc_id").cast("string"), F.lit(".pt"))).when(k == 1, F.lit("/m/checkpoint_best.pt")).when(k == 2, F.lit("/m/a__b.txt")).otherwise(F.lit("/m/x.log"))
    rows = table(spark, d, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", monitor.checkpoint_name(F.col("path")).alias("ckpt"), monitor.result_name(F.col("path")).alias("result"), monitor.decoded_name(F.col("path")).alias("name"))


# the queries of files and streams register themselves in the same catalogue
from lexiloom.plans import file_queries as _file_queries  # noqa: E402, F401
