"""Phrases whose words stand together far more often than chance has it.

Words are ranked by frequency. A task turns texts into ranks once; it counts neighbours in
tiles of the rank-by-rank table, dense ones with ``bincount`` and thin ones as sorted lists
of (cell, count), and Spark adds up what the tasks found. Frequent pairs are ranked in their
turn and take the place of words, so that a phrase of three words is a pair of a pair and a
word, and so on up to the wanted length.

Tasks know the ``HEAD`` most frequent units of a level by rank, however large the corpus
is. All others that may be frequent are told by a sieve of fixed size, which lets through
some rare ones and stops no frequent one; they are counted by their text. So a result never
depends on what fits the head or the sieve.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import batches_up_to, pick
from faultline.session import lookup_join, materialize

# Fixed values of the contract: least count, words, share of a longer phrase, rows per language.
LEAST, LONGEST, COVERED, KEPT = 10, 3, 50, 2000
NO_LANG = "und"
# Words, and units of each longer level, that tasks know by rank; bytes of a head word at most.
HEAD, HEAD_PHRASES, HEAD_BYTES = 1 << 17, 1 << 19, 64
# Ranks on a side of a tile; neighbours of a batch that make a tile dense; dense tiles kept.
TILE, DENSE, TILES = 512, 8192, 16
# 64-bit cells of a sieve.
SIEVE = 1 << 20
# Bytes of text worked on at once; words of an encoded row; cells and texts that a task holds.
BATCH_BYTES = "8m"
SLICE, ROW_WORDS, HELD, HELD_TEXTS = 1 << 18, 1 << 18, 1 << 19, 1 << 16

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(SEPARATORS)
)
_EDGE = re.compile(rb"[ \n]")
_fixed = np.random.default_rng(1013)
_ODD = _fixed.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)

TALLIES = "lang string, word string, f long"
ENCODED = "lang string, ids binary, rest array<string>"
FOUND = "lang string, code long, phrase string, f long"


def slices(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased, with ``\\n`` between pieces; some are empty."""
    raw, at = raw.translate(_PLAIN), 0
    while at < len(raw):
        edge = _EDGE.search(raw, at + SLICE)
        end = edge.start() if edge else len(raw)
        yield raw[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[str, Counter] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, tally in tallies.items():
            tally.pop(b"", None)
            tally.pop(b"\n", None)
            if tally:
                words = pa.array([*tally, None], pa.binary()).cast(pa.string())
                counts = [*tally.values(), sum(tally.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts)), words, pa.array(counts, pa.int64())], names=["lang", "word", "f"]
                )
        tallies.clear()

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in slices(raw):
                tally = tallies.setdefault(lang, Counter())
                before = len(tally)
                tally.update(words)
                held += len(tally) - before
                if held > HELD // 2:
                    yield from out()
                    held = 0
    yield from out()


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, f) of words that occur ``least`` times; word null: all words of the language."""
    tallies = docs.mapInArrow(_words, TALLIES)
    return tallies.groupBy("lang", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())


def mix(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its first words and of its last."""
    x = one * _ODD[0] + two
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    begin = lang.encode() + b"\0"
    return np.array([xxhash.xxh64_intdigest(begin + w) for w in words], dtype=np.uint64)


def phrase_hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases of one number of words."""
    columns = list(zip(*(p.split(b" ") for p in phrases)))
    found = word_hashes(lang, columns[0])
    for column in columns[1:]:
        found = mix(found, word_hashes(lang, column))
    return found


def _cells(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(size - 1)).astype(np.int64), np.uint64(1) << (hashes >> np.uint64(58))


def sieve_of(units: DataFrame, size: int) -> np.ndarray:
    """A bit for each unit (lang, phrase) that the head lacks, in ``size`` cells of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(phrase.encode())
            for lang, phrases in by_lang.items():
                cells, bits = _cells(phrase_hashes(lang, phrases), size)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(bits.view(np.int64))], names=["cell", "bits"])

    rows = units.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(size, dtype=np.uint64)  # at most ``size`` rows arrive
    cells[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return cells


@dataclass
class Level:
    """What tasks know of the units of one length: per language the head, and the sieve."""

    #: Words (level 1) or codes of (rank of the first words, rank of the last), by rank.
    head: dict[str, list[bytes] | np.ndarray]
    sieve: np.ndarray
    size: int
    #: Per language: codes in order with their ranks, and hashes by rank. Made in the task.
    order: dict = field(default_factory=dict)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        cells, bits = _cells(hashes, len(self.sieve))
        return (self.sieve[cells] & bits) != 0


def ranked(units: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent units, with their rank in the language; at most ``size`` rows."""
    short = F.octet_length("phrase") <= HEAD_BYTES * (1 + F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))))
    head = units.where(short).orderBy(F.desc("f"), "lang", "phrase").limit(size)
    order = Window.partitionBy("lang").orderBy(F.desc("f"), "phrase")
    return materialize(head.withColumn("rank", F.row_number().over(order) - 1), "phrase-heads")


def level_of(units: DataFrame, heads: DataFrame, size: int, cells: int) -> Level:
    """The head and the sieve of a level, for tasks. ``units``: (lang, phrase, code, f)."""
    shown = F.when(F.col("code").isNull(), F.col("phrase")).alias("phrase")  # codes need no text
    rows = heads.select("lang", shown, "code").orderBy("lang", "rank").toArrow()
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    head: dict = {}
    for lang in dict.fromkeys(langs):
        own = np.flatnonzero(langs == lang)
        part = rows.slice(own[0], len(own))
        if part.column("code").null_count:  # words
            head[lang] = [p.encode() for p in part.column("phrase").to_pylist()]
        else:
            head[lang] = part.column("code").to_numpy()
    rest = units.join(heads.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    return Level(head, sieve_of(rest.select("lang", "phrase"), cells), size)


class Known(dict):
    """Ranks of head words; a word beyond gets a number of its own if it may be frequent."""

    def __init__(self, lang: str, level: Level):
        super().__init__({w: i for i, w in enumerate(level.head.get(lang, ()))})
        self[b""], self[b"\n"] = -2, -1
        self.begin, self.level, self.rest = lang.encode() + b"\0", level, {}

    def __missing__(self, word: bytes) -> int:
        found = self.rest.get(word)
        if found is None:
            h = xxhash.xxh64_intdigest(self.begin + word)
            if not int(self.level.sieve[h & (len(self.level.sieve) - 1)]) >> (h >> 58) & 1:
                return -1
            found = self.rest[word] = self.level.size + len(self.rest)
        return found


def encoded(docs: DataFrame, level: Level) -> DataFrame:
    """(lang, ids, rest): ranks of the words of some texts one after another, as int32.

    -1 stands between pieces and for rare words, which no frequent phrase can hold. An id
    from the size of the head on means a word of ``rest``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Known] = {}
        parts: dict[str, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, some in parts.items():
                row = [lang], [np.concatenate(some).tobytes()], [[w.decode() for w in known[lang].rest]]
                kinds = (pa.string(), pa.binary(), pa.list_(pa.string()))
                columns = [pa.array(v, k) for v, k in zip(row, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "ids", "rest"])
                known[lang].rest = {}
            parts.clear()
            if len(known) > 64:  # many languages: their heads are made anew
                known.clear()

        end = np.array([-1], dtype=np.int32)
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in known:
                    known[lang] = Known(lang, shared.value)
                for words in slices(raw):
                    ids = np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words))
                    parts.setdefault(lang, []).append(ids[ids != -2])
                    held += len(ids)
                parts.setdefault(lang, []).append(end)
                if held > ROW_WORDS:
                    yield from out()
                    held = 0
        yield from out()

    return docs.mapInArrow(run, ENCODED)


class Tiles:
    """Counts of neighbours (a, b) of head ranks of one language, in bounded memory."""

    def __init__(self, size: int):
        self.across = -(-size // TILE)
        self.dense: dict[int, np.ndarray] = {}
        self.thin: list[np.ndarray] = []
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        tile = (a // TILE) * self.across + b // TILE
        order = np.argsort(tile, kind="stable")
        a, b, tile = a[order], b[order], tile[order]
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        ends = np.append(starts[1:], len(tile))
        thin = np.ones(len(tile), dtype=bool)
        for s, e in zip(starts, ends):
            t = int(tile[s])
            if t not in self.dense and (e - s < DENSE or len(self.dense) >= TILES):
                continue
            cells = (a[s:e] % TILE) * TILE + b[s:e] % TILE
            if t in self.dense and e - s < DENSE:  # few into a tile that is held anyway
                np.add.at(self.dense[t], cells, 1)
            else:
                self.dense.setdefault(t, np.zeros(TILE * TILE, np.int32))
                self.dense[t] += np.bincount(cells, minlength=TILE * TILE).astype(np.int32)
            thin[s:e] = False
        self.thin.append((a[thin] << 32) | b[thin])

    def merge(self) -> int:
        """Sort what is pending into the list of (cell, count); returns its length."""
        fresh, times = np.unique(np.concatenate(self.thin or [np.zeros(0, np.int64)]), return_counts=True)
        self.thin = []
        self.codes, self.counts = summed([self.codes, fresh], [self.counts, times])
        return len(self.codes)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        codes, counts = [self.codes], [self.counts]
        for tile, table in self.dense.items():
            cells = np.flatnonzero(table)
            a, b = tile // self.across * TILE + cells // TILE, tile % self.across * TILE + cells % TILE
            codes.append((a << 32) | b)
            counts.append(table[cells].astype(np.int64))
        return summed(codes, counts)


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of (code, count) as one with each code once, in order."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


class Reader:
    """Units of each length along one encoded row."""

    def __init__(self, lang: str, levels: list[Level], ids: np.ndarray, rest: list[str]):
        self.lang, self.levels = lang, levels
        self.words = ids.astype(np.int64)
        self.rest = [[w.encode() for w in rest]]  # per level: texts of the units beyond the head
        self.own = [word_hashes(lang, self.rest[0])]  # and their hashes
        self.units = self.words
        for depth in range(1, len(levels)):
            self._longer(depth)

    def _order(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a level's head: codes in order, their ranks, hashes by rank."""
        level = self.levels[depth]
        if self.lang not in level.order:
            head = level.head.get(self.lang, [] if depth == 0 else np.zeros(0, np.int64))
            if depth == 0:
                found = np.zeros(0, np.int64), np.zeros(0, np.int64), word_hashes(self.lang, head)
            else:
                order = np.argsort(head, kind="stable")
                hashes = mix(self._order(depth - 1)[2][head >> 32], self._order(0)[2][head & 0xFFFFFFFF])
                found = head[order], order, hashes
            if len(level.order) > 64:
                level.order.clear()
            level.order[self.lang] = found
        return level.order[self.lang]

    def hashes(self, depth: int, units: np.ndarray) -> np.ndarray:
        size, head, own = self.levels[depth].size, self._order(depth)[2], self.own[depth]
        found = np.zeros(len(units), dtype=np.uint64)
        inside = units < size
        found[inside] = head[units[inside]]
        found[~inside] = own[units[~inside] - size]
        return found

    def name(self, depth: int, unit: int) -> bytes:
        level = self.levels[depth]
        if unit >= level.size:
            return self.rest[depth][unit - level.size]
        held = level.head[self.lang][unit]
        if depth == 0:
            return held
        return self.name(depth - 1, int(held) >> 32) + b" " + self.name(0, int(held) & 0xFFFFFFFF)

    def neighbours(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a unit of ``depth`` + 1 words before a word, and that word."""
        last = self.words[depth + 1 :]
        units = self.units[: len(last)]
        both = (units >= 0) & (last >= 0)
        if depth:
            both &= self.units[1 : 1 + len(last)] >= 0  # what starts a word later is frequent too
        return np.flatnonzero(both), last

    def _longer(self, depth: int) -> None:
        places, last = self.neighbours(depth - 1)
        codes, back = np.unique((self.units[places] << 32) | last[places], return_inverse=True)
        keys, ranks, _ = self._order(depth)
        at = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
        inside = keys[at] == codes if len(keys) else np.zeros(len(codes), bool)
        found = np.full(len(codes), -1, dtype=np.int64)
        found[inside] = ranks[at[inside]]
        a, b = codes[~inside] >> 32, codes[~inside] & 0xFFFFFFFF
        hashes = mix(self.hashes(depth - 1, a), self.hashes(0, b))
        may = self.levels[depth].passes(hashes)
        found[np.flatnonzero(~inside)[may]] = self.levels[depth].size + np.arange(may.sum())
        self.rest.append([self.name(depth - 1, int(x)) + b" " + self.name(0, int(y)) for x, y in zip(a[may], b[may])])
        self.own.append(hashes[may])
        units = np.full(len(self.words), -1, dtype=np.int64)
        units[places] = found[back]
        self.units = units


def counted(rows: DataFrame, levels: list[Level]) -> DataFrame:
    """(lang, code, phrase, f): how often tasks met a phrase one word longer than ``levels``.

    ``code`` is (rank of the first words, rank of the last) where both are in heads, else
    null, and ``phrase`` the text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        depth = len(levels) - 1
        tiles: dict[str, Tiles] = {}
        others: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang in {*tiles, *others}:
                codes, counts = tiles[lang].all() if lang in tiles else (np.zeros(0, np.int64),) * 2
                texts = others.get(lang, {})
                total = len(codes) + len(texts)
                columns = [
                    pa.array([lang] * total, pa.string()),
                    pa.concat_arrays([pa.array(codes), pa.nulls(len(texts), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(codes), pa.string()), pa.array([t.decode() for t in texts], pa.string())]),
                    pa.concat_arrays([pa.array(counts), pa.array(list(texts.values()), pa.int64())]),
                ]
                whole = pa.RecordBatch.from_arrays(columns, names=["lang", "code", "phrase", "f"])
                for at in range(0, total, 1 << 16):
                    yield whole.slice(at, 1 << 16)
            tiles.clear()
            others.clear()

        for batch in batches:
            for row in range(batch.num_rows):  # one at a time: a batch holds many long rows
                lang, raw, rest = (batch.column(i)[row].as_py() for i in range(3))
                reader = Reader(lang, levels, np.frombuffer(raw, dtype=np.int32), rest)
                places, last = reader.neighbours(depth)
                a, b = reader.units[places], last[places]
                head = (a < levels[depth].size) & (b < levels[0].size)
                tiles.setdefault(lang, Tiles(levels[0].size)).add(a[head], b[head])
                codes, times = np.unique((a[~head] << 32) | b[~head], return_counts=True)
                tally = others.setdefault(lang, Counter())
                for code, n in zip(codes.tolist(), times.tolist()):
                    tally[reader.name(depth, code >> 32) + b" " + reader.name(0, code & 0xFFFFFFFF)] += n
                held = sum(t.merge() for t in tiles.values())
                if held > HELD or sum(map(len, others.values())) > HELD_TEXTS or sum(len(t.dense) for t in tiles.values()) > 2 * TILES or len(tiles) > 64:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, FOUND)


def named(found: DataFrame, firsts: DataFrame, words: DataFrame) -> DataFrame:
    """Codes of (lang, code, phrase, f) written out, by the heads that they are ranks of."""
    one = firsts.select("lang", F.col("rank").alias("_a"), F.col("phrase").alias("_first"))
    two = F.broadcast(words.select("lang", F.col("rank").alias("_b"), F.col("phrase").alias("_last")))
    rows = found.withColumn("_a", F.shiftright("code", 32)).withColumn("_b", F.col("code").bitwiseAND(0xFFFFFFFF))
    rows = rows.join(one, ["lang", "_a"], "left").join(two, ["lang", "_b"], "left")
    return rows.select("lang", F.coalesce("phrase", F.concat_ws(" ", "_first", "_last")).alias("phrase"), "code", "f")


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)); 38 digits hold it while counts have at most 15."""
    wide = [c.cast("decimal(16,0)") for c in (a, a, left, right)]
    top = (wide[0] * wide[1]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, wide[2] * wide[3])


def phrases(
    docs: DataFrame,
    *,
    least: int = LEAST,
    longest: int = LONGEST,
    covered: int = COVERED,
    kept: int = KEPT,
    head: int = HEAD,
    head_phrases: int = HEAD_PHRASES,
    cells: int = SIEVE,
) -> DataFrame:
    """The ``kept`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty and a null language is ``und``; repeated rows count as often as
    they stand there; ids and other columns are not looked at; without any phrase that
    occurs ``least`` times there are no rows. Equal scores are ordered by count, then by the
    bytes of the phrase, so no ties remain. A text of any length is read in slices that are
    cut between words, and joined again before neighbours are counted.
    """
    rows = pick(docs, "lang", "text", lang="string", text="string")
    texts = rows.select(
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")
    )
    with batches_up_to(docs.sparkSession, BATCH_BYTES):
        words = materialize(word_counts(texts, least), "phrase-words")
        totals = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
        units = words.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.lit(None).cast("long").alias("code"), "f")
        heads = [ranked(units, head)]
        levels = [level_of(units, heads[0], head, cells)]
        ids = materialize(encoded(texts, levels[0]), "phrase-ids")
        counts, longer = units.select("lang", "phrase", "f"), []
        for size in range(2, longest + 1):
            found = counted(ids, levels).groupBy("lang", "code", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
            units = materialize(named(found, heads[-1], heads[0]), "phrase-counts")
            longer.append(units.select("lang", "phrase", F.col("f").alias("a"), F.lit(size).alias("size")))
            counts = counts.unionByName(units.select("lang", "phrase", "f"))
            if size < longest:
                heads.append(ranked(units.where("code IS NOT NULL"), head_phrases))
                levels.append(level_of(units, heads[-1], head_phrases, cells))
    candidates = longer[0]
    for part in longer[1:]:
        candidates = candidates.unionByName(part)
    return best(candidates, counts, totals, longest, covered, kept)


def best(candidates: DataFrame, counts: DataFrame, totals: DataFrame, longest: int, covered: int, kept: int) -> DataFrame:
    """Scores, covers and the first ``kept`` of each language, from frequent phrases only."""
    parts = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k",
        _joined(parts, F.lit(1), F.col("k")).alias("first"),
        _joined(parts, F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    for side, name in (("first", "l"), ("rest", "r")):
        table = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = lookup_join(cuts, table, ["lang", side], spread=["phrase"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    inner = candidates.where("size > 2").withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)))
    inner = inner.select("lang", _joined(parts, F.col("_at"), F.col("_n")).alias("phrase"), F.col("a").alias("_longer"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    left = scored.join(covers, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * covered)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")
    top = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k AS size, c.f AS a, s.k AS k,
         array_to_string(string_split(c.phrase, ' ')[1:s.k], ' ') AS part,
         array_to_string(string_split(c.phrase, ' ')[s.k + 1:], ' ') AS rest
  FROM counts c, (VALUES (1), (2)) AS s(k) WHERE c.k >= 2 AND s.k < c.k
), scored AS (
  SELECT u.lang, u.phrase, u.size, u.a, u.k, p.f AS l, q.f AS r,
         (u.a::HUGEINT * u.a * 1000000 // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts u JOIN counts p ON p.lang = u.lang AND p.phrase = u.part
              JOIN counts q ON q.lang = u.lang AND q.phrase = u.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase
    FROM counts, (VALUES (1), (2)) AS places(i) WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT t.* FROM lowest t LEFT JOIN covered v ON v.lang = t.lang AND v.phrase = t.phrase
  WHERE v.longer IS NULL OR 100 * v.longer < 50 * t.a
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score
FROM ordered o JOIN totals t ON t.lang = o.lang WHERE o.rank <= 2000
"""
