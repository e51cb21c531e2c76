"""Options and vocabulary checks of the translation task, and the description of a serving pipeline."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

# Symbols that stand for parts of a sentence that aren't translated.
NUMBERED_SYMBOLS = ("emoji_trans_ph{}/>", "ignore_trans_ph{}/>", "no_trans_ph{}/>", "punc_trans_ph{}/>")
BREAKER_SYMBOL = "no_trans_breaker/>"
SYMBOLS_PER_SENTENCE = 10


def reserved_symbols() -> list[str]:
    """The breaker, and each kind numbered and without a number."""
    return [BREAKER_SYMBOL] + [s.format(n) for s in NUMBERED_SYMBOLS for n in (*range(SYMBOLS_PER_SENTENCE), "")]


@dataclass
class TaskOptions:
    """The names and defaults of the task's options."""

    data: str
    source_lang: str | None = None
    target_lang: str | None = None
    load_alignments: bool = False
    left_pad_source: bool = True
    left_pad_target: bool = False
    max_source_positions: int = 1024
    max_target_positions: int = 1024
    upsample_primary: int = 1
    truncate_source: bool = False
    num_batch_buckets: int = 0
    lang_prefix_tok: str | None = None
    eval_bleu: bool = False
    eval_bleu_detok: str = "space"
    eval_bleu_detok_args: str | None = None
    eval_tokenized_bleu: bool = False
    eval_bleu_remove_bpe: str | None = None
    eval_bleu_args: str | None = None
    eval_bleu_print_samples: bool = False

    @classmethod
    def of(cls, values: dict[str, object]) -> "TaskOptions":
        """From texts or plain values; an unknown option is an error."""
        kinds = {f.name: str(f.type) for f in fields(cls)}
        out: dict[str, object] = {}
        for name, value in values.items():
            key = name.lstrip("-").replace("-", "_")
            if key not in kinds:
                raise ValueError(f"no option {name}")
            if kinds[key] == "bool" and not isinstance(value, bool):
                if str(value).lower() not in ("true", "false"):
                    raise ValueError(f"{name} is true or false")
                value = str(value).lower() == "true"
            out[key] = int(str(value)) if kinds[key] == "int" else value
        return cls(**out)  # type: ignore[arg-type]

    def folder(self, epoch: int, training: bool = True) -> str:
        """The data folder of an epoch, from 1: round robin in training, else the first."""
        paths = [p for p in self.data.split(":") if p]
        if not paths:
            raise ValueError("no data folder")
        return paths[(epoch - 1) % len(paths)] if training else paths[0]

    def languages(self, existing: set[str]) -> tuple[str, str]:
        """The pair, as given or as the name of a file such as train.en-de.en tells."""
        if self.source_lang and self.target_lang:
            return self.source_lang, self.target_lang
        for name in sorted(existing):
            found = re.match(r"[^.]+\.([^.]+)-([^.]+)\.", name)
            if found:
                return found[1], found[2]
        raise ValueError("no language pair in the file names")


def check_vocabularies(source: dict[str, int], target: dict[str, int], special: tuple[str, ...] = ("<pad>", "</s>", "<unk>")) -> None:
    """Both sides number their special symbols alike, or it is an error."""
    for s in special:
        if s not in source or source.get(s) != target.get(s):
            raise ValueError(f"{s} has different numbers")


#: Languages whose texts get a check of their punctuation and numerals.
CJK_TARGETS = ("zh", "ja", "ko")


def serving_description(source: dict, target: dict, source_tokens: list[str], target_tokens: list[str], protected: list[str], extractor: str = "basic", entities: list[tuple[str, str, str]] | None = None) -> dict:
    """Transformers of both sides, symbol mappers and rectifiers, ready for JSON.

    A side holds language and, where it has them, normalize_punctuation,
    tokenizer (class, parameters), truecase and subword (class, parameters).
    """

    def transformers(side: dict) -> list[tuple[str, dict]]:
        lang = {"lang": side["language"]}
        out = [("DataGate", dict(lang))]
        if "normalize_punctuation" in side:
            out.append(("PunctuationNormalizer", dict(lang)))
        out.append(("UnescapeSpecChars", dict(lang)))
        if "tokenizer" in side:
            kind, how = side["tokenizer"]
            how = dict(how) if kind == "TransformerTokenizer" else how | lang
            out.append((kind, how | ({"glossaries": protected} if kind in ("TransformerTokenizer", "MosesTokenizer") else {})))
        if side.get("truecase") is not None:
            out.append(("MosesTruecaser", {"model_str": side["truecase"] if side is source else ""} | lang))
        if "subword" in side:
            kind, how = side["subword"]
            out.append((kind, how | {"glossaries": protected}))
        return out

    def breaker(pattern: str) -> tuple[str, dict]:
        return "RegexBreaker", {"regex_pattern_string": pattern, "lang": source["language"], "regex_from_etl": True}

    empty = "EMPTY_TOKEN"
    while any(empty in t for t in source_tokens):
        empty += "0"
    mappers = {
        name: [("SymbolsMapper", {"tokens": tokens, "embedding_dim": -1, "att_token": "", "empty_token": mark, "max_len": 255})]
        for name, tokens, mark in (("src_ids", source_tokens, empty), ("trg_ids", target_tokens, ""))
    }
    rectifiers = [breaker("EMOJI_REGEXP_PATTERN_STRING")]
    if target["language"] in CJK_TARGETS:
        rectifiers.append(("ChineseSciformChecker", {}))
    if extractor in ("basic", "ne_plhd"):
        basic = extractor == "basic"
        rectifiers += [breaker("JA_KAOMOJI_REGX")] * basic
        rectifiers += [breaker("LARK_EMOJI_REGEX"), ("UrlPuncBreaker", {"replace_url": basic, "translate_to": target["language"]})]
        if not basic:
            rectifiers.append(("NameEntityBreaker", {"lang": source["language"], "enable_lark": True, "word_mappings": entities or []}))
    return {"src_transformers": transformers(source), "trg_transformers": transformers(target), "mappers": mappers, "rectifiers": rectifiers}
