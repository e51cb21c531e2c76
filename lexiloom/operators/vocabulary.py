"""Word counts, vocabularies, and byte-pair merges over them."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexiloom.functions.tokenizing import tokens
from lexiloom.sources.corpus import settled, ship

END = "</w>"
#: Characters of a word table that learning takes to the driver.
MOST_CHARS = 2_000_000
#: Encoded words that a task keeps.
KEPT_WORDS = 500_000


def word_counts(rows: DataFrame, column: str) -> DataFrame:
    """(token, freq) over blank-separated tokens."""
    return rows.select(F.explode(tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def total_counts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("token").agg(F.sum("freq").alias("freq"))


def cut(vocab: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Frequent tokens, by frequency and then token, both descending."""
    out = vocab.where(F.col("freq") >= least).orderBy(F.desc("freq"), F.desc("token"))
    return out.limit(most) if most else out


def with_language_tokens(vocab: DataFrame, languages: list[str]) -> DataFrame:
    rows = [(f"LANG_TOK_{l.upper()}", -1) for l in languages]
    return vocab.select("token", "freq").unionByName(vocab.sparkSession.createDataFrame(rows, "token string, freq bigint"))


def new_tokens(current: DataFrame, more: DataFrame) -> DataFrame:
    return more.join(current, "token", "left_anti")


def merged(current: DataFrame, more: DataFrame, freq: int = 20) -> DataFrame:
    """The current vocabulary and the tokens that are new, with a fixed frequency."""
    fresh = new_tokens(current, more).select("token", F.lit(freq).cast("bigint").alias("freq"))
    return current.select("token", "freq").unionByName(fresh)


def symbols(token: Column) -> Column:
    """A word's characters, the end mark joined to the last one."""
    chars = F.split(token, "")
    n = F.length(token)
    return F.transform(F.slice(chars, F.lit(1), n), lambda c, i: F.when(i == n - 1, F.concat(c, F.lit(END))).otherwise(c))


def pair_counts(vocab: DataFrame) -> DataFrame:
    """(left, right, freq) over neighbouring symbols of words, weighted by word frequency."""
    s = vocab.select("freq", symbols(F.col("token")).alias("s")).where("size(s) > 1")
    pairs = s.select("freq", F.posexplode(F.slice("s", F.lit(1), F.size("s") - 1)).alias("i", "left"), "s")
    return pairs.select("left", F.get("s", F.col("i") + 1).alias("right"), "freq").groupBy("left", "right").agg(F.sum("freq").alias("freq"))


def learn_merges(vocab: DataFrame, operations: int, least: int = 2, least_freq: int = 1, most_words: int | None = None, most_chars: int = MOST_CHARS) -> list[tuple[str, str]]:
    """Byte-pair merges from word counts, most frequent pair first, ties to the greatest pair.

    A word table of up to ``most_chars`` characters comes to the driver; larger
    ones stay where they are (``SpreadMerger``), and only counts of pairs come.
    ``most_words``: refuse tables with more words.
    """
    rows = vocab.where(F.length("token") > 0).where(F.col("freq") >= least_freq)
    rows = settled(rows.select("token", F.col("freq").cast("bigint").alias("freq")))
    size = rows.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("chars")).first()
    if most_words is not None and size.words > most_words:
        raise ValueError(f"{size.words} words are more than {most_words}: raise least_freq or most_words")
    if size.chars > most_chars:
        return SpreadMerger(rows, most_chars).run(operations, least)
    table = rows.toArrow()
    return Merger(table.column("token"), table.column("freq").to_numpy()).run(operations, least)


class Merger:
    """Words as one array of symbols, linked to their neighbours, with the places of each pair.

    A merge touches the places of its pair alone, all at once.  The pairs of
    single characters, which can be as many as the characters of the table, stay
    in arrays: sorted for their places, and by count for the heap, which gets
    them when it comes down to their count.
    """

    def __init__(self, tokens: pa.ChunkedArray, freqs: np.ndarray):
        length = np.asarray(pc.utf8_length(tokens).to_numpy(), np.int64)
        points = np.frombuffer("".join(tokens.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        last = np.cumsum(length) - 1
        points[last] += 1 << 21  # with the end mark
        known, self.symbol = np.unique(points, return_inverse=True)
        self.names = [chr(p & 0x1FFFFF) + (END if p >> 21 else "") for p in known.tolist()]
        n = len(points)
        self.weight = np.repeat(np.asarray(freqs, np.int64), length)
        self.next, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.next[last] = -1
        self.before[last - length + 1] = -1
        self.counts: dict[int, int] = {}  # of pairs that merges have touched
        self.places: dict[int, list[np.ndarray]] = {}  # that merges have made
        self.heap: list[tuple[int, tuple[int, ...], tuple[int, ...], int]] = []
        self.order: dict[int, tuple[int, ...]] = {}
        self.first, self.sums, self.start, self.at = self._grouped(np.flatnonzero(self.next >= 0))
        self.falling = np.argsort(-self.sums, kind="stable")
        self.fed = 0

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at] << 32 | self.symbol[self.next[at]]

    def _grouped(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that begin at ``at``, their sums, where each one's places begin, and the places."""
        keys = self._pairs(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(self.weight[at], start) if len(start) else np.zeros(0, np.int64)
        return keys[start], sums, np.append(start, len(at)), at

    def _first(self, key: int) -> int | None:
        """The place of a pair among those before any merge."""
        i = int(np.searchsorted(self.first, key))
        return i if i < len(self.first) and self.first[i] == key else None

    def _now(self, key: int) -> int:
        if key in self.counts:
            return self.counts[key]
        i = self._first(key)
        return 0 if i is None else int(self.sums[i])

    def _push(self, key: int, count: int) -> None:
        for x in (key >> 32, key & 0xFFFFFFFF):
            if x not in self.order:
                self.order[x] = _descending((self.names[x], ""))[0]
        heapq.heappush(self.heap, (-count, self.order[key >> 32], self.order[key & 0xFFFFFFFF], key))

    def _count(self, at: np.ndarray, sign: int) -> None:
        """Add the pairs that begin at ``at`` to the counts, or take them off."""
        keys, sums, start, at = self._grouped(at)
        for key, total, i, j in zip(keys.tolist(), sums.tolist(), start.tolist(), start[1:].tolist()):
            count = self._now(key) + sign * total
            self.counts[key] = count
            if sign > 0:
                self.places.setdefault(key, []).append(at[i:j])
            if count > 0:
                self._push(key, count)

    def _feed(self, least: int) -> None:
        """Put those first pairs into the heap that may be the most frequent now."""
        while self.fed < len(self.falling):
            i = self.falling[self.fed]
            count = int(self.sums[i])
            if count < least or self.heap and count < -self.heap[0][0]:
                return
            self.fed += 1
            if int(self.first[i]) not in self.counts:
                self._push(int(self.first[i]), count)

    def _named(self, key: int) -> tuple[str, str]:
        return self.names[key >> 32], self.names[key & 0xFFFFFFFF]

    def run(self, operations: int, least: int) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        while len(out) < operations:
            self._feed(least)
            if not self.heap:
                break
            count, *_, key = heapq.heappop(self.heap)
            if self._now(key) != -count:
                continue
            if -count < least:
                break
            out.append(self._named(key))
            self._merge(key)
        return out

    def _merge(self, key: int) -> None:
        left, right = key >> 32, key & 0xFFFFFFFF
        places, i = self.places.pop(key, []), self._first(key)
        if i is not None:
            places.append(self.at[self.start[i] : self.start[i + 1]])
        at = np.unique(np.concatenate(places))
        at = at[(self.symbol[at] == left) & (self.next[at] >= 0)]
        at = at[self.symbol[self.next[at]] == right]
        if left == right and len(at) > 1:  # of overlapping places the first, third, ..
            chained = np.concatenate([[False], self.next[at[:-1]] == at[1:]])
            begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        gone = self.next[at]
        touched = np.unique(np.concatenate([self.before[at], at, gone]))
        touched = touched[touched >= 0]
        self._count(touched[self.next[touched] >= 0], -1)
        self.names.append(self.names[left] + self.names[right])
        self.symbol[at] = len(self.names) - 1
        self.symbol[gone] = -1
        after = self.next[gone]
        self.next[at] = after
        self.before[after[after >= 0]] = at[after >= 0]
        self.next[gone] = -1
        touched = np.unique(np.concatenate([self.before[at], at]))
        touched = touched[touched >= 0]
        self._count(touched[self.next[touched] >= 0], 1)
        self.counts[key] = 0


class SpreadMerger:
    """Merges of a word table that stays on the executors.

    A guess of the merges is applied to all words there, and every merge's
    changes of pair counts come back, summed over all words.  The driver follows
    them from the counts before the round on: as long as the guess is the most
    frequent pair of these exact counts, the merge is settled; where it isn't, the
    right one is settled, and the next round goes on after it with a better guess.
    No guess decides a result.  The first guess comes from words drawn by
    frequency.

    There can be as many pairs as characters, so only those come that get highest
    by their first count and all that the guess adds to it.  All others stay below
    the last of these, and a pair at or above it is the most frequent of all.
    Further down nothing is settled before the next round; after a round that
    settled nothing it has no guess, and then its first pair is the right one.

    Symbols are numbers: a character's code point, with the end mark
    ``1 << 21`` above it, and merged ones from ``1 << 22`` on, by their text.
    """

    BITS = 23  # of a symbol
    STEPS = 17  # bits of a merge's place
    ROUND = 2000  # merges whose changes come to the driver at once
    PAIRS = 100_000  # pairs that come to the driver at once
    ROWS = 300_000  # their counts and changes

    def __init__(self, rows: DataFrame, most_chars: int):
        ship(rows.sparkSession)
        self.rows, self.most_chars = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)), most_chars
        self.made: list[str] = []
        self.number: dict[str, int] = {}
        self.order: dict[int, tuple[int, ...]] = {}
        self.rounds = 0

    def _number(self, name: str) -> int:
        if len(name) == 1 or name[1:] == END:
            return ord(name[0]) + (1 << 21 if len(name) > 1 else 0)
        if name not in self.number:
            self.number[name] = (1 << 22) + len(self.made)
            self.made.append(name)
        return self.number[name]

    def _name(self, number: int) -> str:
        return _symbol_name(number, self.made)

    def _key(self, pair: tuple[str, str]) -> int:
        return self._number(pair[0]) << self.BITS | self._number(pair[1])

    def _named(self, key: int) -> tuple[str, str]:
        return self._name(key >> self.BITS), self._name(key & ((1 << self.BITS) - 1))

    def _entry(self, key: int, count: int) -> tuple:
        parts = key >> self.BITS, key & ((1 << self.BITS) - 1)
        for p in parts:
            if p not in self.order:
                self.order[p] = _descending((self._name(p), ""))[0]
        return -count, self.order[parts[0]], self.order[parts[1]], key

    def _first_guess(self, operations: int, least: int) -> list[tuple[str, str]]:
        """Merges of words drawn with a chance that grows with their frequency, up to a bound from which all are drawn."""
        bins = self.rows.groupBy(F.floor(F.log2("freq") * 4).alias("bin")).agg(F.sum(F.col("freq").cast("double")).alias("freq"), F.sum(F.length("token")).alias("chars")).collect()
        bound = 1.0
        while sum(min(1.0, 2 ** (r.bin / 4) / bound) * r.chars for r in bins) > max(1, self.most_chars / 2):
            bound *= 1.1
        chance = F.pmod(F.xxhash64("token"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = self.rows.where(F.length("token") <= 64).where(chance * bound < F.col("freq"))
        table = some.select("token", F.greatest("freq", F.lit(int(bound))).alias("freq")).toArrow()
        return Merger(table.column("token"), table.column("freq").to_numpy()).run(operations, least) if len(table) else []

    def _changes(self, merges: list[int], first: int) -> tuple[list[tuple[list[int], list[int]]], tuple | None]:
        """For each step (pairs, changes) over all words, and the last pair's entry if others are left out.

        Step 0 has the counts before the merge at place ``first``; the merge at place ``first`` + i is step i + 1.
        """
        pairs = np.array(merges, np.int64)
        made = np.array([self._number("".join(self._named(k))) for k in merges], np.int64)
        bits, steps, texts_made = self.BITS, self.STEPS, list(self.made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[pa.RecordBatch]:
                keys, sums = replay.result()
                for i in range(0, len(keys), 50_000):
                    k = keys[i : i + 50_000]
                    yield pa.record_batch({"pair": pa.array(k & ((1 << 2 * bits) - 1)), "step": pa.array((k >> 2 * bits).astype(np.int32)), "n": pa.array(sums[i : i + 50_000])})

            replay = Replay(pairs, made, first, bits, steps)
            for b in batches:
                replay.add(b.column("token"), b.column("freq"))
                if replay.full():
                    yield from rows()
            yield from rows()

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pair = b.column("pair").to_numpy()
                texts = []
                for part in (pair >> bits, pair & ((1 << bits) - 1)):
                    known, where = np.unique(part, return_inverse=True)
                    texts.append(pa.array([_symbol_name(x, texts_made) for x in known.tolist()], pa.string()).take(pa.array(where)))
                yield pa.record_batch([*b.columns, *texts], names=[*b.schema.names, "left", "right"])

        changed = self.rows.mapInArrow(run, "pair bigint, step int, n bigint").repartition("pair")
        changed = changed.groupBy("pair", "step").agg(F.sum("n").alias("n")).where("n <> 0")
        reach = changed.groupBy("pair").agg(F.sum(F.greatest("n", F.lit(0))).alias("reach"), F.collect_list(F.struct("step", "n")).alias("each"))
        reach = settled(reach.mapInArrow(named, "pair bigint, reach bigint, each array<struct<step:int,n:bigint>>, left string, right string"))
        order = F.desc("reach"), F.desc("left"), F.desc("right")
        top = reach.select("reach", "left", "right", F.size("each").alias("rows")).orderBy(*order).limit(self.PAIRS + 1).toArrow()
        fit = min(self.PAIRS, max(1, int(np.searchsorted(np.cumsum(top.column("rows").to_numpy()), self.ROWS, "right"))))
        cut = None
        if fit < len(top):
            n, left, right = (top.column(c)[fit - 1].as_py() for c in ("reach", "left", "right"))
            reach = reach.where((F.col("reach") > n) | (F.col("reach") == n) & ((F.col("left") > left) | (F.col("left") == left) & (F.col("right") >= right)))
            cut = -n, *_descending((left, right))
        table = reach.select("pair", F.explode("each").alias("x")).select("pair", "x.step", "x.n").toArrow()
        step, pair, n = (table.column(c).to_numpy() for c in ("step", "pair", "n"))
        by = np.argsort(step, kind="stable")
        step, pair, n = step[by], pair[by], n[by]
        cuts = np.searchsorted(step, np.arange(len(merges) - first + 2))
        return [(pair[i:j].tolist(), n[i:j].tolist()) for i, j in zip(cuts, cuts[1:])], cut

    def run(self, operations: int, least: int) -> list[tuple[str, str]]:
        if operations > 100_000:
            raise ValueError(f"{operations} merges are more than 100000")
        spare = operations // 10 + 10  # guessed merges may come later than they should
        guess = [self._key(p) for p in self._first_guess(min(operations, self.ROUND) + spare, least)]
        done: list[int] = []
        while len(done) < operations:
            self.rounds += 1
            first, at = len(done), 0
            guess = guess[: self.ROUND + spare]
            changes, cut = self._changes(done + guess, first)
            counts: dict[int, int] = {}
            heap: list[tuple] = []
            self._apply(counts, heap, changes[0])
            later = dict(zip(guess, changes[1:]))
            while len(done) < operations:
                best = self._best(counts, heap, least)
                if best is None and (cut is None or -cut[0] < least):
                    return [self._named(k) for k in done]
                if best is None or cut is not None and heap[0][:3] > cut:
                    break
                done.append(best)
                right = at < len(guess) and guess[at] == best
                self._apply(counts, heap, changes[at + 1] if right else later.pop(best, ([], [])))
                if not right:
                    counts.pop(best, None)
                    break
                later.pop(best, None)
                at += 1
            guess = self._guess(counts, heap, later, min(operations - len(done), self.ROUND) + spare, least) if len(done) > first else []
        return [self._named(k) for k in done]

    def _guess(self, counts: dict[int, int], heap: list[tuple], changes: dict[int, tuple[list[int], list[int]]], most: int, least: int) -> list[int]:
        """Further merges by the changes of the last round, as if they didn't depend on the order."""
        out: list[int] = []
        while len(out) < most and (best := self._best(counts, heap, least)) is not None:
            out.append(best)
            self._apply(counts, heap, changes.pop(best, ([], [])))
            counts.pop(best, None)
        return out

    def _apply(self, counts: dict[int, int], heap: list[tuple], change: tuple[list[int], list[int]]) -> None:
        for key, n in zip(*change):
            count = counts.get(key, 0) + n
            if count:
                counts[key] = count
            else:
                counts.pop(key, None)
            if count > 0:
                heapq.heappush(heap, self._entry(key, count))

    @staticmethod
    def _best(counts: dict[int, int], heap: list[tuple], least: int) -> int | None:
        """The most frequent pair, which stays in the heap."""
        while heap and counts.get(heap[0][-1], 0) != -heap[0][0]:
            heapq.heappop(heap)
        return heap[0][-1] if heap and -heap[0][0] >= least else None


class Replay:
    """Applies merges in their order to words, and sums up how each changes the counts of pairs.

    In each round every word that isn't done merges the places of the first
    merge that follows its last one; words are taken in pieces of bounded size.
    Step 0 has the counts of pairs before the merge at place ``first``.
    """

    CHARS = 1_000_000
    KEPT = 2_000_000  # sums that are kept apart; half as many are passed on
    NONE = np.int64(1 << 40)

    def __init__(self, pairs: np.ndarray, made: np.ndarray, first: int, bits: int, steps: int):
        self.made, self.first, self.bits, self.steps = made, first, bits, steps
        self.places = np.sort(pairs << steps | np.arange(len(pairs)))
        self.words: list[tuple[pa.Array, np.ndarray]] = []
        self.chars = 0
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, tokens: pa.Array, freqs: pa.Array) -> None:
        self.words.append((tokens, freqs.to_numpy(zero_copy_only=False)))
        self.chars += pc.sum(pc.utf8_length(tokens)).as_py() or 0
        if self.chars > self.CHARS:
            self._work()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums since the last result."""
        self._work()
        self._sum_up()
        out, self.sums = self.sums, []
        return out[0] if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def full(self) -> bool:
        return len(self.sums) == 1 and len(self.sums[0][0]) > self.KEPT // 2

    def _sum_up(self) -> None:
        if len(self.sums) > 1:
            self.sums = [_summed(*(np.concatenate(x) for x in zip(*self.sums)))]

    def _pairs(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return symbol[at] << self.bits | symbol[at + 1]

    def _work(self) -> None:
        words, self.words, self.chars = self.words, [], 0
        tokens = [t for b, _ in words for t in b.to_pylist()]
        if not tokens:
            return
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbol = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol[np.cumsum(length) - 1] += 1 << 21
        weight = np.repeat(np.concatenate([f for _, f in words]), length)
        word = np.repeat(np.arange(len(tokens)), length)
        last = np.full(len(tokens), -1, np.int64)
        keys, sums = [], []

        def note(step: np.ndarray | int, at: np.ndarray, sign: int) -> None:
            keys.append(step << 2 * self.bits | self._pairs(symbol, at))
            sums.append(sign * weight[at])

        begun = np.zeros(len(tokens), bool)  # with its pairs in step 0
        while len(symbol) > 1:
            rank = np.full(len(symbol), self.NONE)
            joined = np.flatnonzero(word[:-1] == word[1:])
            pair = self._pairs(symbol, joined)
            if len(self.places):
                at = np.minimum(np.searchsorted(self.places, pair << self.steps | (last[word[joined]] + 1)), len(self.places) - 1)
                hit = self.places[at] >> self.steps == pair
                # a pair may come again later on: its next place after the word's last merge
                place = self.places[at[hit]] & ((1 << self.steps) - 1)
                later = place > last[word[joined[hit]]]
                rank[joined[hit][later]] = place[later]
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(start, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            begins = (least >= self.first) & ~begun[word]
            note(0, joined[begins[joined]], 1)
            begun[word[begins]] = True
            still = least < self.NONE
            symbol, word, weight, rank, least = symbol[still], word[still], weight[still], rank[still], least[still]
            if not len(symbol):
                break
            at = np.flatnonzero(rank == least)
            if len(at) > 1:  # of overlapping places the first, third, ..
                chained = np.concatenate([[False], (at[:-1] + 1 == at[1:]) & (word[at[:-1]] == word[at[1:]])])
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            last[word[at]] = rank[at]
            counted = np.flatnonzero(least[at] >= self.first)
            touched = np.zeros(len(symbol) + 2, bool)
            for shift in (-1, 0, 1):
                touched[at[counted] + shift] = True  # -1 is the last entry, which is never a pair
            near = np.flatnonzero(touched[: len(symbol) - 1] & (word[:-1] == word[1:]))
            note(least[near] - self.first + 1, near, -1)
            symbol[at] = self.made[rank[at]]
            fresh = np.zeros(len(symbol), bool)
            fresh[at[counted]] = True
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, weight, least, fresh = symbol[keep], word[keep], weight[keep], least[keep], fresh[keep]
            near = np.flatnonzero((fresh[:-1] | fresh[1:]) & (word[:-1] == word[1:]))
            note(least[near] - self.first + 1, near, 1)
        if keys:
            self.sums.append(_summed(np.concatenate(keys), np.concatenate(sums)))
        if sum(len(k) for k, _ in self.sums) > self.KEPT:
            self._sum_up()


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values' sum of each key, in the order of keys."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(values, start)


def _symbol_name(number: int, made: list[str]) -> str:
    return made[number - (1 << 22)] if number >> 22 else chr(number & 0x1FFFFF) + (END if number >> 21 else "")


def _descending(pair: tuple[str, str]) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(-ord(c) for c in s) + (1,) for s in pair)


def merge_pair(symbols_: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(symbols_):
        if i + 1 < len(symbols_) and (symbols_[i], symbols_[i + 1]) == pair:
            out.append(symbols_[i] + symbols_[i + 1])
            i += 2
        else:
            out.append(symbols_[i])
            i += 1
    return out


class WordEncoder:
    """Splits words by ranked merges.

    ``allowed``: pieces outside it are split back along the merges.
    ``glossary``: entries are cut out of words and stay whole.  ``version``: in
    codes of version 0.1 the end mark is a symbol of its own, in 0.2 it belongs
    to the last character.
    """

    def __init__(self, merges: list[tuple[str, str]], allowed: set[str] | None = None, glossary: list[str] | None = None, version: tuple[int, int] = (0, 2), mark: str = "@@"):
        if version not in ((0, 1), (0, 2)):
            raise ValueError(f"no codes of version {version}")
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(merges):
            self.ranks.setdefault(m, i)
        self.allowed, self.glossary, self.version, self.mark = allowed, glossary or [], version, mark
        self.halves = {a + b: (a, b) for a, b in reversed(self.ranks)}
        self.splits: dict[tuple[str, bool], list[str]] = {}

    def many(self) -> Callable[[list[str]], list[list[str]]]:
        """The same for a list of non-empty words."""
        if self.glossary or self.version != (0, 2):
            return lambda words: [self(w) for w in words]
        return BatchEncoder(self)

    def __call__(self, word: str) -> list[str]:
        parts = [word]
        for entry in self.glossary:
            parts = [x for p in parts for x in self._isolated(p, entry)]
        pieces = [x for p in parts for x in self._pieces(p)]
        return [p + self.mark for p in pieces[:-1]] + pieces[-1:]

    @staticmethod
    def _isolated(part: str, entry: str) -> list[str]:
        if part == entry or entry not in part:
            return [part]
        between = [x for rest in part.split(entry) for x in (rest, entry)][:-1]
        return [x for x in between if x]

    def constrained(self, parts: list[str]) -> list[str]:
        """Merged parts split back to what is allowed, with marks."""
        pieces = [x for i, p in enumerate(parts) for x in self._split_once(p, i == len(parts) - 1)]
        return [p + self.mark for p in pieces[:-1]] + pieces[-1:]

    def _split_once(self, piece: str, final: bool) -> list[str]:
        """At most two entries for each merge and character."""
        key = piece, final
        if key not in self.splits:
            self.splits[key] = self._split(piece, final)
        return self.splits[key]

    def _pieces(self, part: str) -> list[str]:
        """Without marks; the end mark is taken off the last one."""
        if part in self.glossary or not part:
            return [part] if part else []
        parts = [*part, END] if self.version == (0, 1) else [*part[:-1], part[-1] + END]
        while len(parts) > 1:
            pair = min(zip(parts, parts[1:]), key=lambda p: self.ranks.get(p, 1 << 60))
            if pair not in self.ranks:
                break
            parts = merge_pair(parts, pair)
        parts = parts[:-1] if parts[-1] == END else [*parts[:-1], parts[-1].removesuffix(END)]
        if self.allowed is None:
            return parts
        return [x for i, p in enumerate(parts) for x in self._split(p, i == len(parts) - 1)]

    def _split(self, piece: str, final: bool) -> list[str]:
        """Pieces that are allowed, or can't be split further."""
        halves = self.halves.get(piece + END if final else piece)
        if halves is None or (piece if final else piece + self.mark) in self.allowed:
            return [piece]
        left, right = halves[0], halves[1].removesuffix(END) if final else halves[1]
        return self._split(left, False) + (self._split(right, final) if right else [])


class BatchEncoder:
    """The merges of ``WordEncoder`` for many words at once, version 0.2 and without a glossary.

    In each round every word that isn't done merges the places of its pair of
    least rank; the words are one array of symbols throughout.
    """

    NONE = np.int64(1 << 40)

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder
        self.names = sorted({x for pair in encoder.ranks for x in (*pair, pair[0] + pair[1])})
        number = {n: i for i, n in enumerate(self.names)}
        rows = sorted((number[a] << 32 | number[b], rank, number[a + b]) for (a, b), rank in encoder.ranks.items())
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        # characters as code points, with the end mark above them
        self.points = {ord(n[0]) + (1 << 21 if len(n) > 1 else 0): i for n, i in number.items() if len(n) == 1 or n[1:] == END}

    def _look(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of each place's pair with its right neighbour."""
        rank, made = np.full(len(symbol), self.NONE), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1 and len(self.keys):
            key = np.where(word[:-1] == word[1:], symbol[:-1] << 32 | symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
        return rank, made

    def __call__(self, words: list[str]) -> list[list[str]]:
        """Pieces of non-empty words."""
        if not words:
            return []
        length = np.fromiter(map(len, words), np.int64, len(words))
        point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        point[np.cumsum(length) - 1] += 1 << 21
        known, where = np.unique(point, return_inverse=True)
        # characters in no merge get numbers of their own
        symbol = np.array([self.points.get(p, len(self.names) + p) for p in known.tolist()], np.int64)[where]
        word = np.repeat(np.arange(len(words)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank, made = self._look(symbol, word)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(word))))
            still = least < self.NONE
            if not still.all():
                done.append((word[~still], symbol[~still]))
                symbol, word, rank, made, least = symbol[still], word[still], rank[still], made[still], least[still]
            at = np.flatnonzero(rank == least)
            if len(at) > 1:  # of overlapping places the first, third, ..
                chained = np.concatenate([[False], at[:-1] + 1 == at[1:]])
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]).tolist()
        used, where = np.unique(symbol[order], return_inverse=True)
        shown = [self._shown(x) for x in used.tolist()]
        flat = [shown[i] for i in where.tolist()]
        parts = [flat[i:j] for i, j in zip(cuts, cuts[1:])]
        if self.encoder.allowed is None:
            return [[p + self.encoder.mark for p in w[:-1]] + w[-1:] for w in parts]
        return [self.encoder.constrained(w) for w in parts]

    def _shown(self, x: int) -> str:
        name = self.names[x] if x < len(self.names) else chr((x - len(self.names)) & 0x1FFFFF)
        return name.removesuffix(END)


def encode_word(word: str, ranks: dict[tuple[str, str], int], allowed: set[str] | None = None, **how) -> list[str]:
    """Pieces of one word; see ``WordEncoder``."""
    return WordEncoder(sorted(ranks, key=ranks.get), allowed, **how)(word) if word else []


def encode_words(words: DataFrame, merges: list[tuple[str, str]], allowed: set[str] | None = None, **how) -> DataFrame:
    """(token, pieces): every distinct word encoded once, in Arrow batches; ``how`` as for ``WordEncoder``."""

    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = WordEncoder(merges, allowed, **how).many()
        for b in batches:
            yield pa.record_batch({"token": b.column("token"), "pieces": pa.array(many(b.column("token").to_pylist()), pa.list_(pa.string()))})

    return words.select("token").where("token <> ''").distinct().mapInArrow(run, "token string, pieces array<string>")


def piece_counts(words: DataFrame, merges: list[tuple[str, str]], allowed: set[str] | None = None, **how) -> DataFrame:
    """(token, freq) of the pieces of a word table (token, freq), without a join; each batch sends its sums; ``how`` as for ``WordEncoder``."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = WordEncoder(merges, allowed, **how).many()
        for b in batches:
            pieces = pa.array(many(b.column("token").to_pylist()), pa.list_(pa.string()))
            flat = pa.table({"token": pieces.flatten(), "freq": b.column("freq").take(pc.list_parent_indices(pieces))})
            yield from flat.group_by("token").aggregate([("freq", "sum")]).rename_columns(["token", "freq"]).to_batches()

    rows = words.where("token <> ''").select("token", F.col("freq").cast("bigint").alias("freq"))
    return rows.mapInArrow(run, "token string, freq bigint").groupBy("token").agg(F.sum("freq").alias("freq"))


def encode(rows: DataFrame, key: list[str], column: str, merges: list[tuple[str, str]], allowed: set[str] | None = None, **how) -> DataFrame:
    """``key`` and the pieces of each row's tokens, without a shuffle; ``how`` as for ``WordEncoder``.

    A task encodes each distinct word of a batch once, and keeps up to
    ``KEPT_WORDS`` of them for its next batches.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(merges, allowed, **how)
        many = encoder.many()
        known: dict[str, list[str]] = {"": []}
        for b in batches:
            texts = b.column(column).cast(pa.large_string()).fill_null("")
            words = pc.split_pattern(texts, " ")
            codes = words.flatten().dictionary_encode()
            distinct = codes.dictionary.to_pylist()
            if len(known) + len(distinct) > KEPT_WORDS:
                known = {"": []}
            fresh = [w for w in distinct if w not in known]
            known.update(zip(fresh, many(fresh)))
            own = [known[w] for w in distinct]
            size = np.fromiter(map(len, own), np.int64, len(own))
            first = np.cumsum(size) - size
            at = codes.indices.to_numpy(zero_copy_only=False)
            count = size[at] if len(own) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(count)])
            places = np.repeat(first[at] - total[:-1], count) + np.arange(total[-1]) if len(own) else np.zeros(0, np.int64)
            values = pa.array([p for w in own for p in w], pa.string()).take(pa.array(places, pa.int64()))
            offsets = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            pieces = pa.ListArray.from_arrays(pa.array(total[offsets], pa.int32()), values)
            yield pa.record_batch([*(b.column(c) for c in key), pieces], names=[*key, "pieces"])

    some = rows.select(*key, column) if column not in key else rows.select(*key)
    return some.mapInArrow(run, rows.select(*key).schema.add("pieces", ArrayType(StringType())))


def token_ids(rows: DataFrame, key: list[str], pieces: str, ids: DataFrame, unknown: int) -> DataFrame:
    """Pieces as numbers of ``ids`` (token, id)."""
    flat = rows.select(*key, F.posexplode(pieces).alias("at", "token")).join(ids, "token", "left").select(*key, "at", F.coalesce("id", F.lit(unknown)).alias("id"))
    return flat.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("_l")).select(*key, F.col("_l.id").alias("ids"))


def token_id(ids: DataFrame, token: str, unknown: int) -> int:
    """The number of a language token that decoding starts with; an unknown one is an error."""
    found = ids.where(F.col("token") == token).select("id").first()
    if found is None or found.id == unknown:
        raise ValueError(f"{token} is not in the vocabulary")
    return found.id


def write_merges(merges: list[tuple[str, str]], spark: SparkSession, folder: str) -> None:
    """A merge table as text: a version line, then a pair a line, in order."""
    lines = ["#version: 0.2", *(f"{a} {b}" for a, b in merges)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(folder)


def write_vocabulary(vocab: DataFrame, folder: str, separator: str = "\t") -> None:
    """Token and frequency a line, by frequency and then token, both descending; files in the order of their names."""
    line = F.concat_ws(separator, "token", F.col("freq").cast("string")).alias("value")
    cut(vocab).select(line).write.mode("overwrite").text(folder)
