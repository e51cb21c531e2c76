"""Lexicons as graphs, and substitution of words through them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.sources.corpus import draw, hashed, settled, ship

SPACE = 16**7
#: Entries of a lexicon that every worker may hold, some 200 bytes each; a larger one is joined.
LOOKED_UP = 100_000


def grouped(entries: DataFrame) -> DataFrame:
    """(lang, src_word, trg_words): targets in rank order, repeats kept as weights."""
    return entries.groupBy("lang", "src_word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "trg_word"))), lambda x: x.trg_word).alias("trg_words"))


def by_depth(entries: DataFrame) -> DataFrame:
    """(src_lang, src_word, depth, words): the candidates (trg_word, trg_lang) of each word and depth."""
    return entries.groupBy("src_lang", "src_word", "depth").agg(F.sort_array(F.collect_list(F.struct("trg_word", "trg_lang"))).alias("words"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct()


def neighbours(edges: DataFrame, depth: int = 3) -> DataFrame:
    """(src, dst, depth): the words within ``depth`` steps of each word, with the fewest steps.

    The edges and each depth are settled, so that no depth computes the earlier ones again.
    """
    step = settled(undirected(edges))
    known = step.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("depth"))
    frontier = known
    for d in range(2, depth + 1):
        reached = frontier.join(step, frontier.dst == step.a).where(F.col("src") != F.col("b")).select("src", F.col("b").alias("dst")).distinct()
        frontier = settled(reached.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(frontier)
    return known


def adjacency_lines(found: DataFrame) -> DataFrame:
    """Tab-separated lines: a word, then each word it reaches with its depth."""
    cell = F.concat_ws("__", "dst", F.col("depth").cast("string"))
    cells = found.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("depth", cell.alias("cell")))).alias("l"))
    return cells.select("src", F.concat_ws("\t", "src", F.col("l.cell")).alias("line"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest word reachable from each, by contraction rounds, each of which is settled."""
    left = settled(undirected(edges).select("a", "b").where("a < b"))
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hops = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to"))
        hops = settled(hops)
        rounds.append(hops)
        ta, tb = hops.select(F.col("id").alias("a"), F.col("to").alias("ta")), hops.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        left = left.join(ta, "a").join(tb, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        left = settled(left)
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = rounds[-1].select("id", F.col("to").alias("component"))
    for hops in reversed(rounds[:-1]):
        later = out.select(F.col("id").alias("to"), "component")
        out = hops.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return out


def substitute(rows: DataFrame, entries: DataFrame, languages: list[str], prob: float = 0.15, copies: int = 1, seed: str = "1", most: int | None = None) -> DataFrame:
    """Dictionary substitution: (row key, lang, tokens, replaced) of copies with at least one replaced token.

    ``rows``: (id, tokens), one row an id; ``entries``: (lang, src_word, trg_word, rank).  Each
    row takes ``copies`` of ``languages`` by the smallest hash; each token that
    the lexicon has is replaced with probability ``prob`` by the candidate of
    smallest hash.  The draws depend on (seed, row, place) alone.  ``most``: the
    number of entries at most, where a cap is known.
    """
    order = F.array_sort(F.array(*(F.struct(hashed(seed, F.col("id"), F.lit(l)).alias("h"), F.lit(l).alias("lang")) for l in languages)))
    chosen = rows.select("id", "tokens", F.explode(F.slice(order, 1, copies).lang).alias("lang"))
    candidates = entries.groupBy("lang", F.col("src_word").alias("token")).agg(F.sort_array(F.collect_list(F.struct("rank", "trg_word"))).alias("c"))
    return _replaced(chosen, candidates, ["lang", "token"], prob, seed, most)


def _replaced(chosen: DataFrame, candidates: DataFrame, keys: list[str], prob: float, seed: str, most: int | None = None) -> DataFrame:
    """Rows of (id, lang, tokens) with words drawn from ``candidates`` (keys, c: (rank, trg_word)).

    A lexicon that is known to have no more than ``most`` entries, and those no
    more than ``LOOKED_UP``, goes to every worker, and no text is shuffled.  In
    others the drawn words are looked up by a join.
    """
    if most is not None and most <= LOOKED_UP:
        return _looked_up(chosen, candidates, keys, prob, seed)
    words = chosen.select("id", *dict.fromkeys(["lang", *keys[:-1]]), F.posexplode("tokens").alias("pos", "token"))
    hit = words.where(draw(seed, "p", F.col("id"), F.col("lang"), F.col("pos")) < int(prob * SPACE)).join(candidates, keys)
    drawn = F.transform("c", lambda x: F.struct(hashed(seed, "c", F.col("id"), F.col("lang"), F.col("pos"), x["rank"]).alias("h"), x["trg_word"].alias("word")))
    changes = hit.select("id", "lang", "pos", F.array_min(drawn).word.alias("word")).groupBy("id", "lang").agg(F.map_from_entries(F.collect_list(F.struct("pos", "word"))).alias("changes"))
    # counted before the join, so that queries of counts alone don't move the texts
    out = chosen.where(F.size("tokens") > 0).select("id", "lang", "tokens", F.size("tokens").cast("bigint").alias("total")).join(changes, ["id", "lang"], "left")
    tokens = F.transform("tokens", lambda x, i: F.coalesce(F.element_at("changes", i), x))
    replaced = F.when(F.col("changes").isNull(), 0).otherwise(F.size("changes")).cast("bigint")
    return out.select("id", "lang", tokens.alias("tokens"), replaced.alias("replaced"), "total")


def _looked_up(chosen: DataFrame, candidates: DataFrame, keys: list[str], prob: float, seed: str) -> DataFrame:
    """The same draws, row by row in Arrow batches, with the lexicon as a table of each worker."""
    ship(chosen.sparkSession)
    table: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for r in candidates.select(F.col(keys[0]).alias("k"), "token", "c").toArrow().to_pylist():  # at most LOOKED_UP entries
        table[r["k"], r["token"]] = [(str(x["rank"]), x["trg_word"]) for x in r["c"]]
    shared = chosen.sparkSession.sparkContext.broadcast(table)
    limit = int(prob * SPACE)
    rows = chosen.where(F.size("tokens") > 0).select("id", "lang", "tokens", F.col(keys[0]).alias("k"))
    types = dict(rows.dtypes)

    def md5(text: str) -> str:
        return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            texts, counts = [], []
            for id_, lang, tokens, k in zip(*(b.column(c).to_pylist() for c in ("id", "lang", "tokens", "k"))):
                own, changed = list(tokens), 0
                for at, token in enumerate(tokens):
                    found = known.get((k, token))
                    if found and int(md5(f"{seed}|p|{id_}|{lang}|{at}")[:7], 16) < limit:
                        own[at] = min((md5(f"{seed}|c|{id_}|{lang}|{at}|{rank}"), word) for rank, word in found)[1]
                        changed += 1
                texts.append(own)
                counts.append(changed)
            sizes = b.column("tokens").value_lengths().cast(pa.int64())
            yield pa.record_batch({"id": b.column("id"), "lang": b.column("lang"), "tokens": pa.array(texts, pa.list_(pa.string())), "replaced": pa.array(counts, pa.int64()), "total": sizes})

    return rows.mapInArrow(run, f"id {types['id']}, lang string, tokens array<string>, replaced long, total long")


def substitute_multi(rows: DataFrame, entries: DataFrame, targets: list[str], prob: float = 0.15, max_depth: int = 1, copies: int = 1, seed: str = "1", most: int | None = None) -> DataFrame:
    """Substitution through a multi-way lexicon: ``rows`` (id, src_lang, tokens), ``entries`` (src_lang, src_word, trg_lang, trg_word, depth).

    A candidate at depth d weighs 2 ** (max depth - d); candidates outside
    ``targets`` are left out before the draw.  ``lang`` in the result numbers
    the copies.
    """
    seen = W.partitionBy("src_lang", "src_word")
    depths = entries.withColumn("_d", F.size(F.collect_set("depth").over(seen))).withColumn("_m", F.least(F.col("_d"), F.lit(max_depth)))
    kept = depths.where((F.col("depth") <= F.col("_m")) & F.col("trg_lang").isin(targets))
    weighted = kept.withColumn("_w", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("_m") - F.col("depth")).cast("int"))))
    rank = F.concat_ws("~", "trg_lang", "trg_word", F.col("_w").cast("string"))
    candidates = weighted.groupBy("src_lang", F.col("src_word").alias("token")).agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "trg_word"))).alias("c"))
    numbered = rows.select("id", "src_lang", "tokens", F.explode(F.sequence(F.lit(1), F.lit(copies)).cast("array<string>")).alias("lang"))
    return _replaced(numbered, candidates, ["src_lang", "token"], prob, seed, most)


def augmented(found: DataFrame) -> DataFrame:
    """Copies with a replaced token."""
    return found.where("replaced > 0")


def statistics(found: DataFrame) -> DataFrame:
    t, r = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("replaced"), F.lit(0))
    return found.agg(t.cast("bigint").alias("total_tokens"), r.cast("bigint").alias("replaced_tokens"), F.round(100 * r / F.nullif(t, F.lit(0)), 6).alias("percent"))
