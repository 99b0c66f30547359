"""Near-duplicate texts by an inverted join over the coordinates of MinHash signatures.

A signature is a set of tokens (coordinate, value). Two texts that agree in T of K
coordinates share a token among the K - T + 1 first of each, in any order of all tokens.
So a text is posted under these few only; with rare tokens first, values that a common
passage brings to many texts are hardly ever posted. Texts that meet in a posting list and
may still matter are counted over the whole signature, and who passes is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import texts, worker_state
from faultline.llm.links import components
from faultline.llm.pieces import Powers, hashes, mixed
from faultline.session import lookup_join, materialize

WORDS = 5
# The limit of the contract, and that of a corpus, where near copies go from 0.8 on.
PERCENT, CORPUS_PERCENT = 85, 80
COORDINATES = 64
# The chance at most with which a pair at the limit itself is missed.
MISS = 2.5e-6
# Counters of the frequency sketch: one fixed array, whatever the input.
COUNTERS = 1 << 16
# Bytes of text worked on at once; rows and bytes of one of the two chunks of a block.
SLICE, BLOCK, BLOCK_BYTES = 1 << 19, 1024, 16 << 20

_fixed = np.random.default_rng(925)
_STEPS = _fixed.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_FLIPS = _fixed.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_TIMES = _fixed.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def agreement(percent: int) -> int:
    """Of the coordinates, those that a pair must agree in: as many as ``MISS`` allows.

    The number that agree has a binomial law; at 85 percent 40 have to, at 80 percent 35. A
    limit so low that no number of at least one keeps to ``MISS`` is refused.
    """
    share, below, least = percent / 100, 0.0, 0
    if 0 < share <= 1:
        for k in range(COORDINATES):
            below += math.comb(COORDINATES, k) * share**k * (1 - share) ** (COORDINATES - k)
            if below > MISS:
                break
            least = k + 1
    if not least:
        raise ValueError(f"no number of {COORDINATES} coordinates finds pairs from {percent} percent on")
    return least


def shingle_sets(values: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    encoded = [v.encode("utf-8") for v in values]
    lengths = np.array([len(e) + 1 for e in encoded], dtype=np.int64)
    data = np.frombuffer(b" ".join([*encoded, b""]), dtype=np.uint8).copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    powers = worker_state("hash-powers", Powers)
    hashed = hashes(data, starts, ends, powers)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    if len(powers.up) > 4 * SLICE:
        powers.grow(1 << 16)  # a giant text leaves no giant tables behind
    total = np.zeros(max(0, len(hashed) - WORDS + 1), dtype=np.uint64)
    for i in range(WORDS):
        total += hashed[i : i + len(total)] * _STEPS[i]
    total = mixed(total)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            found.append(np.unique(total[a : b - WORDS + 1]))
        elif b > a:
            few = (hashed[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            found.append(mixed(few + _STEPS[WORDS : WORDS + 1] * np.uint64(b - a)))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of coordinates (unsigned 32-bit) for each set, none of which is empty."""
    joined = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    found = np.empty((len(sets), COORDINATES), dtype="<u4")
    for k in range(COORDINATES):
        values = ((joined ^ _FLIPS[k]) * _TIMES[k]) >> np.uint64(32)
        found[:, k] = np.minimum.reduceat(values, first)
    return found


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    one = mixed(shingles).sum(dtype=np.uint64)
    two = mixed(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "little") + int(two).to_bytes(8, "little")


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about ``SLICE`` bytes of text each."""
    sizes = np.cumsum([len(t) + 1 for t in batch.column(column).to_pylist()])
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, 1):
            sets = shingle_sets(part.column(1).to_pylist())
            full = [s for s in sets if len(s)]
            rows = iter(signatures_of(full) if full else [])
            signs = [next(rows).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(signs, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "key", "sign"],
            )


def tokens_of(signs: pa.Array) -> np.ndarray:
    """Tokens of each signature: coordinate and value, mixed one to one into 64 bits."""
    values = np.frombuffer(b"".join(signs.to_pylist()), dtype="<u4").reshape(-1, COORDINATES).astype(np.uint64)
    return mixed(values + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            counts += np.bincount(_slot(tokens_of(batch.column(0))).ravel(), minlength=COUNTERS)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])


def near_links(sets: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of sets (sorted hashes as bytes) are similar enough."""
    found = np.zeros(len(sets), dtype=bool)
    for i, (x, y) in enumerate(zip(sets["x"], sets["y"])):
        a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        found[i] = 100 * both >= percent * (len(a) + len(b) - both)
    return found


def _agree(one: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that agree in enough coordinates and whose sizes allow a link."""
    least = agreement(percent)
    x = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("m"), F.col("sign").alias("x"))
    y = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("sign").alias("y"))
    pairs = one.join(x, "a").join(y, "b").where(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
                    for c in (2, 3)
                )
                enough = pa.array((x == y).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(enough)

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _exactly(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[near_links(batch, percent), ["a", "b"]]

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of classes, from a text of each: documents are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                found = [
                    (node, s.astype("<u8").tobytes())
                    for node, key, s in zip(
                        part.column(2).to_pylist(), part.column(3).to_pylist(), shingle_sets(part.column(1).to_pylist())
                    )
                    if len(s) and set_key(s) == key  # an id may stand on several texts
                ]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

    named = wanted.select(F.col("rep").alias("doc_id"), "node", "key")
    found = lookup_join(texts(docs), named, ["doc_id"], spread=["text"])
    found = found.select("doc_id", "text", "node", "key").mapInArrow(run, "node long, shingles binary")
    return found.dropDuplicates(["node"])


def _blocks(rows: DataFrame, group: str, size: Column) -> DataFrame:
    """Rows of groups with several parts, dealt to blocks: each pair of chunks is one.

    A chunk has about ``BLOCK`` rows and ``BLOCK_BYTES`` of ``size`` at most.
    """
    groups = rows.groupBy(group).agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.sum(size).alias("size")
    )
    chunks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES)).cast("int")
    rows = rows.join(groups.where("low <> high").select(group, chunks.alias("chunks")), group)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
    return rows.drop("other", "chunks")


def _compared(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """Pairs (a, b) that join the parts of each block: links, or where no sets are given, agreeing pairs."""
    block = [group, "first", "second"]
    rows = rows.select(*block, "own", "node", "part", "n_shingles", "sign", "shingles")
    rows = rows.repartition(*block).sortWithinPartitions(*block, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            start = 0
            for end in [*block_ends(batch), None]:
                waiting.append(batch.slice(start) if end is None else batch.slice(start, end - start))
                if waiting[0].num_rows and waiting[-1].num_rows and not _same(waiting[0], waiting[-1]):
                    yield joining_pairs(pa.Table.from_batches(waiting[:-1]), percent)
                    waiting = waiting[-1:]
                waiting = [w for w in waiting if w.num_rows]
                start = end
        if waiting:
            yield joining_pairs(pa.Table.from_batches(waiting), percent)

    return rows.mapInArrow(run, "a long, b long")


def block_ends(batch: pa.RecordBatch) -> list[int]:
    """Where blocks change inside a batch of sorted rows."""
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for k in range(3):
        values = batch.column(k).to_numpy()
        change |= values[1:] != values[:-1]
    return (np.flatnonzero(change) + 1).tolist()


def _same(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
    return all(x.column(k)[0].as_py() == y.column(k)[0].as_py() for k in range(3))


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of 64 bytes each row of x agrees with y, added up eight at a time."""
    words = (x == y).view(np.uint64)
    total = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        total += words[:, k]
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


def joining_pairs(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of a block that make one part of several, fewer than it has rows.

    A row is compared with those behind it that are of another part by then, first by the
    low byte of each coordinate, then by the coordinates, then by the sets if there are any.
    """
    own, nodes, part, sizes = (rows[c].to_numpy() for c in ("own", "node", "part", "n_shingles"))
    part, n, least = part.copy(), rows.num_rows, agreement(percent)
    one = rows["first"][0].as_py() == rows["second"][0].as_py()
    signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
    low = np.ascontiguousarray(signs.astype(np.uint8))
    exact = n > 0 and rows["shingles"][0].is_valid
    if exact:
        values = np.frombuffer(b"".join(rows["shingles"].to_pylist()), dtype="<u8")
        values, places = np.unique(values, return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(values), dtype=bool)
    found = []
    for i in range(n - 1):
        may = part[i + 1 :] != part[i]
        if not one:
            may &= own[i + 1 :] != own[i]
        may &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        at = np.flatnonzero(may) + i + 1
        if len(at):
            at = at[agreeing(low[at], low[i]) >= least]
            at = at[(signs[at] == signs[i]).sum(axis=1) >= least]
        if exact and len(at):
            mine = places[bounds[i] : bounds[i + 1]]
            mark[mine] = True
            theirs = np.concatenate([places[bounds[j] : bounds[j + 1]] for j in at.tolist()])
            both = np.add.reduceat(mark[theirs], np.cumsum([0, *sizes[at[:-1]]]), dtype=np.int64)
            mark[mine] = False
            at = at[100 * both >= percent * (sizes[i] + sizes[at] - both)]
        if len(at):
            others, which = np.unique(part[at], return_index=True)
            found += [(nodes[i], nodes[j]) for j in at[which].tolist()]
            part[np.isin(part, others)] = part[i]
    columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(2)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A text's set has its distinct five-word shingles, A-Z in lower case, words parted by
    blanks; with fewer words the whole sequence is the one shingle. A null, empty or blank
    text has an empty set and is linked with nothing. Two texts are linked where
    100 * intersection >= ``percent`` * union, found through signatures and confirmed on the
    full sets; a pair at the limit is missed with a chance of ``MISS`` at most, and a limit
    for which signatures can't promise that is refused. component_id is the smallest doc_id
    of linked texts; kept is that document. Rows that repeat a text are in one component,
    rows that repeat an id only if their texts are linked; a row without an id has no
    component and is not kept, and a set that only such rows have links nothing. An empty
    table gives an empty result; other columns are not looked at.

    Equal sets are folded to one class before they are posted, so a group of copies is one
    row. In each posting list the most typical class (the one whose tokens are the most
    frequent) is paired with the others: as many pairs as postings. Collisions of a pair are
    counted over the whole signature, and pairs that agree enough make families. A list
    whose classes are of one family by then is skipped; what is left of the others is
    counted in blocks, where classes of one family skip each other too. Links are pairs of
    a family whose full sets are similar enough: the pairs with a typical class first, then
    in families that these leave in several parts, block by block, the pairs that may still
    join two parts. A block returns fewer pairs than it has rows, so a family of thousands of
    texts that are all alike costs rows in proportion.
    """
    return _components_of(docs, percent).drop("key")


def _components_of(docs: DataFrame, percent: int) -> DataFrame:
    """What ``near_duplicates`` returns, and the key of each row's set."""
    spark, prefix = docs.sparkSession, COORDINATES - agreement(percent) + 1
    signed = texts(docs).mapInArrow(_sign, "doc_id long, n_shingles long, key binary, sign binary")
    signed = materialize(signed, "signatures")
    classes = signed.where("key IS NOT NULL").groupBy("key", "n_shingles", "sign").agg(F.min("doc_id").alias("rep"))
    classes = classes.where("rep IS NOT NULL").withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "near-classes")

    counted = classes.select("sign").mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n"))
    sketch = np.zeros(COUNTERS, dtype=np.int64)
    for slot, n in counted.collect():  # at most COUNTERS rows
        sketch[slot] = n
    sent = spark.sparkContext.broadcast(sketch)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = tokens_of(batch.column(1))
            often = sent.value[_slot(tokens)]
            typical = np.log(often).sum(axis=1)
            first = np.lexsort((tokens, often), axis=1)[:, :prefix]
            columns = [
                np.take_along_axis(tokens, first, axis=1).ravel().view(np.int64),
                np.repeat(batch.column(0).to_numpy(), prefix),
                np.repeat(typical.astype(np.float32), prefix),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "typical"])

    posted = classes.select("node", "sign").mapInArrow(post, "token long, node long, typical float")
    lists = posted.groupBy("token").agg(
        F.count("*").alias("size"), F.max(F.struct("typical", "node")).getField("node").alias("hub")
    )
    # Lists of one class say nothing; what is left is small, so it is stored.
    shared = materialize(posted.join(lists.where("size > 1"), "token").select("token", "node", "hub"), "postings")
    star = shared.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    star = star.distinct()
    near = materialize(_agree(star, classes, percent), "near-pairs")

    # Families: classes that agree enough, in chains. Every link lies inside a family.
    family = materialize(components(near), "near-families").select(F.col("id").alias("node"), "component")
    # The hub of a list has met all others; who is left matters if from several families.
    at = shared.where("node <> hub").join(family, "node", "left")
    at = at.select("token", "node", F.coalesce("component", "node").alias("part"))
    rest = _blocks(at, "token", F.lit(0)).join(classes.select("node", "n_shingles", "sign"), "node")
    rest = rest.withColumn("shingles", F.lit(None).cast("binary"))
    more = _compared(rest, "token", percent)
    family = components(near.union(more)).select(F.col("id").alias("node"), F.col("component").alias("family"))
    family = materialize(family.join(classes, "node"), "near-families")
    sets = materialize(_sets(docs, family.select("rep", "node", "key")), "near-sets")

    links = materialize(_exactly(near, sets, percent), "near-links")
    parts = components(links).select(F.col("id").alias("node"), "component")
    at = family.join(parts, "node", "left").join(sets, "node")
    at = at.select("family", "node", F.coalesce("component", "node").alias("part"), "n_shingles", "sign", "shingles")
    at = materialize(at, "near-members")
    rest = _blocks(at.select("family", "node", "part", "n_shingles"), "family", 8 * F.col("n_shingles"))
    rest = rest.drop("n_shingles").join(at.select("node", "n_shingles", "sign", "shingles"), "node")
    parts = components(links.union(_compared(rest, "family", percent)))

    named = classes.select("key", "node", "rep").join(parts.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    found = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"), "key")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, columns as they are.

    Rows without an id stay, as no other row can name them. Of an id that stands on several
    texts only the rows go whose own text is a copy of another document.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    found = _components_of(docs, percent).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "key", "kept")
    found = materialize(found, "near-found")
    gone = found.groupBy("_id").agg(F.max("kept").alias("some")).join(found.where("NOT kept"), "_id")
    gone = materialize(gone.select("_id", F.col("key").alias("_key"), "some").distinct(), "near-gone")
    rows = docs.toDF(*names).withColumn("_id", F.col(names[id_at]).cast("long"))
    whole = gone.where("NOT some").select("_id").distinct()
    kept = lookup_join(rows, whole, ["_id"], "left_anti", spread=[names[text_at]])
    part = gone.where("some").select("_id", "_key")
    if not part.isEmpty():
        ids = part.select("_id").distinct().withColumn("_part", F.lit(True))
        kept = lookup_join(kept, ids, ["_id"], "left", spread=[names[text_at]])
        text = F.when(F.col("_part"), F.col(names[text_at]).cast("string"))
        kept = kept.withColumn("_key", F.pandas_udf(_keys, "binary")(F.coalesce(text, F.lit(""))))
        kept = lookup_join(kept, part, ["_id", "_key"], "left_anti", spread=[names[text_at]])
    return kept.select(*names).toDF(*docs.columns)


def _keys(values: pd.Series) -> pd.Series:
    """The key of each text's set; null for an empty one."""
    sets = (shingle_sets([v])[0] for v in values)
    return pd.Series([set_key(s) if len(s) else None for s in sets], dtype=object)
