"""Named operators put together: a registry, encoders, and the preparation pipeline."""

from __future__ import annotations

import json
import subprocess
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import cleaning, tokenizing
from lexiloom.operators import corpora, lexicon, sampling, vocabulary
from lexiloom.plans.config import RunConfig
from lexiloom.sources.corpus import capped, ship

_REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def keep(f: Callable[..., Column]) -> Callable[..., Column]:
        _REGISTRY[name] = f
        return f

    return keep


@register("None")
def _same(column: Column, lang: str) -> Column:
    return column


@register("Moses")
def _rules(column: Column, lang: str) -> Column:
    return tokenizing.tokenize(column, lang)


@register("Penn")
def _treebank(column: Column, lang: str) -> Column:
    return tokenizing.tokenize_treebank(column)


@register("Char")
def _characters(column: Column, lang: str) -> Column:
    return tokenizing.split_cjk(column)


def segmenter(name: str, segment: Callable[[str], list[str]]) -> None:
    """Plug in a word segmenter by a Python function; it runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else " ".join(segment(t)))

    _REGISTRY[name] = lambda column, lang: run(column)


def tokenizer(name: str) -> Callable[..., Column]:
    """The tokenizer of that name; unknown names are an error."""
    if name not in _REGISTRY:
        raise ValueError(f"no tokenizer named {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


class Encoder(ABC):
    """A reversible transformation of a text column."""

    @abstractmethod
    def encode(self, rows: DataFrame, column: str) -> DataFrame: ...

    @abstractmethod
    def decode(self, rows: DataFrame, column: str) -> DataFrame: ...

    def spec(self) -> dict:
        return {"class": type(self).__name__}


class MergeEncoder(Encoder):
    def __init__(self, merges: list[tuple[str, str]], key: list[str]):
        self.merges, self.key = merges, key

    def encode(self, rows: DataFrame, column: str) -> DataFrame:
        coded = vocabulary.encode(rows, self.key, column, self.merges)
        return rows.join(coded, self.key).withColumn(column, F.array_join("pieces", " ")).drop("pieces")

    def decode(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn(column, tokenizing.without_subwords(F.col(column)))

    def spec(self) -> dict:
        return super().spec() | {"merges": len(self.merges), "separator": "@@"}


class Pipeline:
    """Encoders one after the other; decoding goes backwards."""

    def __init__(self, encoders: list[Encoder]):
        self.encoders = encoders

    def encode(self, rows: DataFrame, column: str) -> DataFrame:
        for e in self.encoders:
            rows = e.encode(rows, column)
        return rows

    def decode(self, rows: DataFrame, column: str) -> DataFrame:
        for e in reversed(self.encoders):
            rows = e.decode(rows, column)
        return rows

    @staticmethod
    def from_json(text: str, make: dict[str, Callable[[dict], Encoder]]) -> "Pipeline":
        """The encoders that ``to_json`` named, each made from its entry by ``make``."""
        return Pipeline([make[t["class"]](t) for t in json.loads(text)["transformers"]])

    def to_json(self) -> str:
        return json.dumps({"transformers": [e.spec() for e in self.encoders]}, sort_keys=True)


def per_command(rows: DataFrame, column: str, command: list[str]) -> DataFrame:
    """A program over batches of one text column: it reads lines and writes as many.

    Line breaks inside a text go in as blanks.  The program must be installed on
    every executor.
    """

    def run(texts: list[str | None]) -> list[str]:
        sent = "".join((t or "").replace("\n", " ") + "\n" for t in texts)
        got = subprocess.run(command, input=sent, capture_output=True, text=True, check=True).stdout.split("\n")[:-1]
        if len(got) != len(texts):
            raise ValueError(f"{command[0]} wrote {len(got)} lines for {len(texts)}")
        return got

    return per_batch(rows, column, run)


def per_batch(rows: DataFrame, column: str, f: Callable[[list[str]], list[str]]) -> DataFrame:
    """A Python function over batches of one text column, as an operator."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, column, pa.array(f(b.column(i).to_pylist()), pa.string()))

    return rows.mapInArrow(run, rows.schema)


def prepare(rows: DataFrame, config: RunConfig, merges: list[tuple[str, str]] | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Parallel rows (id, src_lang, trg_lang, src, trg) through the configured steps: clean, subword, merge, ras.

    Rows of all pairs go through one plan; the per-pair and per-language
    settings become conditions on the language columns.  With ``directions`` the
    merge step turns each pair into them and resamples each by its ratio.
    """
    languages = config.names("languages")
    pairs = config.names("pairs")
    if "clean" in config.steps:
        drop = [p for p in pairs if config.pair(p).deduplicate]
        if drop or not pairs:
            pair = F.concat_ws("_", "src_lang", "trg_lang")
            wanted = F.lit(True) if not pairs else pair.isin(drop) | F.concat_ws("_", "trg_lang", "src_lang").isin(drop)
            once = rows.where(wanted).groupBy("src_lang", "trg_lang", "src", "trg").agg(F.min("id").alias("id")).select("id", "src_lang", "trg_lang", "src", "trg")
            rows = once.unionByName(rows.where(~wanted).select("id", "src_lang", "trg_lang", "src", "trg"))
        for side in ("src", "trg"):
            out = F.when(F.lit(False), F.col(side))
            for l in languages:
                own = config.language(l)
                text = cleaning.clean(F.col(side), l, own.do_normalize_punctuations)
                out = out.when(F.col(f"{side}_lang") == l, tokenizer(own.tokenizer)(text, l))
            rows = rows.withColumn(side, out.otherwise(F.col(side)))
        if any(config.pair(p).shuffle for p in pairs):
            rows = sampling.shuffled(rows, F.col("id")).drop("place")
    words = rows
    if "subword" in config.steps and merges is not None:
        for side in ("src", "trg"):
            coded = vocabulary.encode(rows, ["id"], side, merges).select("id", F.array_join("pieces", " ").alias(side))
            rows = rows.drop(side).join(coded, "id")
    if "ras" in config.steps and entries is not None:
        own = config.substitution
        others = [l for l in own.languages if l != "en"]
        kept = capped(entries.where(F.col("lang").isin(others)), own.vocab_size, ["lang"])
        found = lexicon.substitute(words.select("id", tokenizing.tokens(F.col("src")).alias("tokens")), kept, others, own.replace_prob, own.num_repeat, most=(own.vocab_size + 1) * len(others))
        copies = lexicon.augmented(found).select("id", F.array_join("tokens", " ").alias("src"))
        if "subword" in config.steps and merges is not None:
            copies = vocabulary.encode(copies, ["id"], "src", merges).select("id", F.array_join("pieces", " ").alias("src"))
        rows = rows.select("id", "src_lang", "trg_lang", "src", "trg").unionByName(copies.join(rows.drop("src"), "id").select("id", "src_lang", "trg_lang", "src", "trg"))
    if "merge" not in config.steps:
        return rows
    directions = config.names("directions")
    return corpora.merged(corpora.in_directions(rows, directions, config.ratios) if directions else rows)
