"""Readers: text corpora, lexicons, vocabularies, merge tables, logs, embeddings, configuration."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, so that its functions can be loaded there; every operator with Python workers does so first."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, folder, True)
        path = Path(folder) / "lexiloom-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    It is spark.checkpoint.dir; only a local session without one gets a
    temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="lexiloom-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
        atexit.register(_drop, context, context.getCheckpointDir())
    return context.getCheckpointDir()


def _drop(context: SparkContext, folder: str) -> None:
    """At the end of Python: the application's own part of the checkpoint folder goes, if the session is still up."""
    if SparkContext._active_spark_context is context and context._jvm is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, which cuts its lineage and survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a line; line_no counts from 0 in each row of ``docs``."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def text_corpus(spark: SparkSession, path: str, lang: str, across_files: bool = False) -> DataFrame:
    """(lang, file, line_no, text) of text files; line_no follows each file's order, or goes on from file to file by name.

    A line's number is its place in its block of the file and the lines of the
    blocks before, so that a large file is numbered by many tasks.
    """
    rows = spark.read.text(path).select(F.lit(lang).alias("lang"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    order = W.orderBy("file", "block") if across_files else W.partitionBy("file").orderBy("block")  # a row for each block of a file
    bases = counts.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("base"))
    number = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("number", number).join(bases, ["file", "block"]).select("lang", "file", (F.col("number") + F.col("base")).cast("bigint").alias("line_no"), "text")


def parallel_corpus(src: DataFrame, trg: DataFrame, alignments: DataFrame | None = None) -> DataFrame:
    """Two sides joined by line number; a missing side is an empty line.  With ``alignments``, also ``align``, null where a line has none."""
    a = src.select("line_no", F.col("text").alias("src"))
    b = trg.select("line_no", F.col("text").alias("trg"))
    both = a.join(b, "line_no", "full").select("line_no", F.coalesce("src", F.lit("")).alias("src"), F.coalesce("trg", F.lit("")).alias("trg"))
    return both if alignments is None else both.join(alignments.select("line_no", F.col("text").alias("align")), "line_no", "left")


def pair_directory(first: str, second: str, existing: set[str], separator: str = "_") -> str:
    """The folder of a pair, under either order of its names."""
    for name in (f"{first}{separator}{second}", f"{second}{separator}{first}"):
        if name in existing:
            return name
    raise FileNotFoundError(f"no folder for {first} and {second}")


def turns(conversations: DataFrame) -> DataFrame:
    """Pairs of a user turn and the assistant turn that follows it."""
    a = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    b = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("trg"))
    return a.join(b, ["conv_id", "turn"])


def lexicon(rows: DataFrame, cap: int, column: str = "value") -> DataFrame:
    """(src_word, trg_word, rank) of a two-column text lexicon; ``cap`` + 1 rows are kept."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    out = rows.select("rank", F.get(parts, F.lit(0)).alias("src_word"), F.get(parts, F.lit(1)).alias("trg_word"), F.size(parts).alias("width"))
    return out.where("width = 2").drop("width").orderBy("rank").limit(cap + 1)


def capped(entries: DataFrame, cap: int, by: list[str]) -> DataFrame:
    """The first ``cap`` + 1 entries of each group by rank."""
    n = F.row_number().over(W.partitionBy(*by).orderBy("rank"))
    return entries.withColumn("_n", n).where(F.col("_n") <= cap + 1).drop("_n")


def multi_lexicon(rows: DataFrame, column: str, source_languages: list[str] | None = None, mark: str = "__", cap: int | None = None, order: str | None = None) -> DataFrame:
    """(src_lang, src_word, trg_lang, trg_word, depth) of tab-separated adjacency lines.

    With ``cap``, the first ``cap`` + 1 lines of a source language by ``order``
    (a column of ``rows``), or of all languages; others don't count.
    """
    if cap is not None:
        if source_languages:
            rows = rows.where(F.lower(F.substring(column, 1, 2)).isin(source_languages))
        rows = rows.orderBy(order).limit(cap + 1)
    cells = F.split(F.col(column), "\t")
    head = F.get(cells, F.lit(0))
    out = rows.select(head.alias("head"), F.explode(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).alias("cell"))
    word = lambda c: F.substring(c, 5, 1 << 20)
    at = F.length("cell") - F.length(F.substring_index("cell", mark, -1)) - len(mark)
    out = out.select(
        F.lower(F.substring("head", 1, 2)).alias("src_lang"),
        word(F.col("head")).alias("src_word"),
        F.lower(F.substring("cell", 1, 2)).alias("trg_lang"),
        F.substring(F.col("cell"), F.lit(5), at - 4).alias("trg_word"),
        F.substring_index("cell", mark, -1).cast("int").alias("depth"),
    )
    return out.where(F.col("src_lang").isin(source_languages)) if source_languages else out


def edge_list(rows: DataFrame, column: str) -> DataFrame:
    """(a, b) of lines with two words, apart by a blank or else by a tab."""
    blank, tab = F.split(F.col(column), " "), F.split(F.col(column), "\t")
    two = F.when(F.size(blank) == 2, blank).when(F.size(tab) == 2, tab)
    return rows.select(F.get(two, F.lit(0)).alias("a"), F.get(two, F.lit(1)).alias("b")).where("a is not null")


def edge_files(spark: SparkSession, paths: list[str], most: int = 100) -> DataFrame:
    """(a, b) of the first ``most`` files of two-word lines."""
    return edge_list(spark.read.text(paths[:most]), "value")


def vocabulary(rows: DataFrame, column: str, separator: str = r"\s+", threshold: int = 0) -> DataFrame:
    parts = F.split(F.col(column), separator)
    out = rows.select(F.get(parts, F.lit(0)).alias("token"), F.expr("try_cast(get(split(`{0}`, '{1}'), 1) as bigint)".format(column, separator.replace("\\", "\\\\"))).alias("freq"))
    return out.where(F.col("freq") >= threshold)


def merges(rows: DataFrame) -> DataFrame:
    """(rank, left, right) of merge lines with their rank; a header goes, the first of equal pairs stays."""
    parts = F.split(F.rtrim("value"), " ")
    out = rows.where(~F.col("value").startswith("#version")).select("rank", F.get(parts, F.lit(0)).alias("left"), F.get(parts, F.lit(1)).alias("right"))
    return out.where("right is not null").groupBy("left", "right").agg(F.min("rank").alias("rank")).select("rank", "left", "right")


def score_log(rows: DataFrame, column: str, skip_averaged: bool = False) -> DataFrame:
    """(ts, ckpt, testset, score) of tab-separated lines; lines without a number as score go."""
    part = lambda i: F.get(F.split(F.col(column), "\t"), F.lit(i))
    out = rows.select(
        *[c for c in rows.columns if c != column],
        F.to_timestamp(part(0), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        part(1).alias("ckpt"),
        part(2).alias("testset"),
        part(3).try_cast("double").alias("score"),
    ).where("score is not null")
    return out.where(~F.col("ckpt").contains("_avg_")) if skip_averaged else out


def generation_log(rows: DataFrame, column: str) -> DataFrame:
    """(line_type, id, score, text) of decoder lines S-, T-, H- and P-; other lines go."""
    line = F.col(column)
    fields = F.split(line, "\t")
    kind = F.substring(line, 1, 1)
    rest = lambda n: F.array_join(F.slice(fields, F.lit(n), F.greatest(F.size(fields) - (n - 1), F.lit(0))), "\t")
    hyp = kind == "H"
    return rows.where(line.rlike(r"^[STHP]-[0-9]+(\t|$)")).select(
        *[c for c in rows.columns if c != column],
        kind.alias("line_type"),
        F.regexp_extract(line, r"^[STHP]-([0-9]+)", 1).cast("bigint").alias("id"),
        F.when(hyp, F.get(fields, F.lit(1)).try_cast("double")).alias("score"),
        F.when(hyp, rest(3)).otherwise(rest(2)).alias("text"),
    )


def nonbreaking_prefixes(spark: SparkSession, folder: str, lang: str, most: int = 100_000) -> dict[str, int]:
    """Abbreviations of the file nonbreaking_prefix.<lang>, of English where a language has none: 1, or 2 for those before numbers only.

    Lines that begin with # and empty ones don't count.  The table is part of a
    plan's expressions, so a file of more than ``most`` lines is an error.
    """
    for name in (lang, "en"):
        path = f"{folder.rstrip('/')}/nonbreaking_prefix.{name}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            break
    else:
        raise FileNotFoundError(f"no abbreviations in {folder}")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} abbreviations in {path}")
    out: dict[str, int] = {}
    for r in rows:
        head, mark, _ = r.value.rpartition("#NUMERIC_ONLY#")
        if mark and head != head.rstrip():
            out[head.rstrip()] = 2
        else:
            out[r.value] = 1
    return out


def patterns(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """The regular expressions of a file of protected patterns, or the entries of a glossary, one a line."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns in {path}")
    return [r.value for r in rows]


def embedding_files(spark: SparkSession, vectors: str, sentences: str, lang: str) -> DataFrame:
    """(lang, id, text, vec): comma-separated vectors, and tab-separated ids and sentences, line by line."""
    v = text_corpus(spark, vectors, lang, across_files=True).select("line_no", F.split("text", ",").cast("array<float>").alias("vec"))
    t = text_corpus(spark, sentences, lang, across_files=True)
    parts = F.split(F.trim("text"), "\t")
    return t.select("line_no", "lang", F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("text")).join(v, "line_no").select("lang", "id", "text", "vec")


def write_embeddings(rows: DataFrame, folder: str, lang: str) -> None:
    """(id, text, vec) as the two files that ``embedding_files`` reads, with one order."""
    one = settled(rows.select("id", "text", "vec").orderBy("id"))
    one.select(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("value")).write.mode("overwrite").text(f"{folder}/{lang}_sent_avg_pool.csv")
    one.select(F.concat_ws("\t", F.col("id").cast("string"), "text").alias("value")).write.mode("overwrite").text(f"{folder}/{lang}.txt")


def shards(existing: set[str], split: str, src: str, trg: str, combine: bool = True) -> list[tuple[str, bool]]:
    """Name prefixes of a dataset's shards, and whether the pair is stored the other way round.

    ``existing`` holds names like train.en-de.en.  Shards are split, split1, ..
    up to the first that isn't there; no shard at all is an error.
    """
    out: list[tuple[str, bool]] = []
    while not out or combine:
        name = split + (str(len(out)) if out else "")
        for a, b in ((src, trg), (trg, src)):
            if f"{name}.{a}-{b}.{src}" in existing:
                out.append((f"{name}.{a}-{b}.", a != src))
                break
        else:
            if not out:
                raise FileNotFoundError(f"no dataset {split} of {src} and {trg}")
            break
    return out


def embeddings(rows: DataFrame, dimension: int) -> DataFrame:
    return rows.where((F.size("embedding") == dimension) & F.col("embedding").isNotNull())


def checkpoints(names: DataFrame, column: str, newest: int, update_based: bool = False, upper_bound: int | None = None) -> DataFrame:
    """The newest checkpoints by the number in their name."""
    pattern = r"checkpoint_\d+_(\d+)\.pt$" if update_based else r"checkpoint(\d+)\.pt$"
    step = F.regexp_extract(column, pattern, 1).try_cast("bigint")
    out = names.select(column, step.alias("step")).where("step is not null")
    if upper_bound is not None:
        out = out.where(F.col("step") <= upper_bound)
    return out.orderBy(F.desc("step")).limit(newest)


def flat_config(tree: dict, prefix: str = "") -> dict[str, str]:
    """Nested keys joined by underscores, values as text."""
    out: dict[str, str] = {}
    for key, value in tree.items():
        if isinstance(value, dict):
            out |= flat_config(value, f"{prefix}{key}_")
        else:
            out[prefix + key] = str(value).lower() if isinstance(value, bool) else str(value)
    return out


def hashed(*parts: Column | str) -> Column:
    """md5 of the parts joined by a bar: the source of all reproducible draws."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 16**7 - 1."""
    return F.conv(F.substring(hashed(*parts), 1, 7), 16, 10).cast("bigint")
