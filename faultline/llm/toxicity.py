"""Toxicity by a subsequence kernel machine with Nyström landmarks.

Texts are read as letters, with one sign for whatever stands between them. The kernel of two
stretches of text counts the subsequences of three signs that they share, each less the more
signs lie in its gaps, so an insult with inserted characters stays near the plain one. A
linear support vector machine is trained on the Nyström features of stretches; since the
kernel is a product of subsequence counts, the machine with all its landmarks folds into one
table of weights per subsequence, and whole texts are scored with it by array work. The
sum of weights over a stretch, divided by the norm of its counts, is the machine's value; a
text has the largest value of all its stretches. Subsequences with fewer than two letters
don't count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import texts, worker_state
from faultline.llm.quality import held_out, training_labels
from faultline.session import materialize

# Signs in a subsequence reach over REACH places; each place left out costs the factor DECAY.
REACH, DECAY = 6, 0.6
# Places at which the subsequences of a stretch start.
STRETCH = 8
SIGNS_BITS = 5
CODES = 1 << (3 * SIGNS_BITS)
GAP, OTHER = 0, 27
# Labelled documents that are fitted at most, landmarks, rounds of looking for stretches.
TRAIN_ROWS, LANDMARKS, ROUNDS = 6000, 160, 6
# Stretches taken of a toxic and of a clean document in each round.
TAKEN = 2
COST, NEWTON = 4.0, 30
THRESHOLD = 0.7
# Characters of texts, and places of stretches, worked on at once.
SLICE, PLACES = 1 << 19, 1 << 16

OFFSETS = tuple(combinations(range(1, REACH), 2))
WEIGHTS = tuple(DECAY ** (k - 2) for _, k in OFFSETS)


def _signs() -> np.ndarray:
    """The sign of each character: 1 to 26 for Latin letters without marks, other letters, gaps."""
    found = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        found[point] = ord(base) - 96 if "a" <= base <= "z" else OTHER if base.isalpha() else GAP
    found[0x2000:0x2C00] = GAP
    found[0x3000:0x3005] = GAP
    return found


def signs_of(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of texts one after another, and where each starts and ends.

    Gaps of any length are one sign; a text has one before it and enough behind it that no
    subsequence and no stretch reaches into the next.
    """
    table = worker_state("toxicity-signs", _signs)
    room = REACH + STRETCH
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    signs = table[np.frombuffer("".join(values).encode("utf-32-le"), dtype="<u4")]
    of = np.repeat(np.arange(len(values)), lengths)
    keep = signs != GAP
    keep[1:] |= (signs[:-1] != GAP) & (of[1:] == of[:-1])
    signs, of = signs[keep], of[keep]
    sizes = np.bincount(of, minlength=len(values)) + 1
    starts = np.cumsum(sizes + room) - sizes - room
    out = np.zeros(int((sizes + room).sum()), dtype=np.uint8)
    out[np.arange(len(signs)) + 1 + of * (room + 1)] = signs
    return out, starts, starts + sizes


def responses(signs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of a table's weights over the subsequences of the stretch from each place on."""
    n = len(signs) - REACH
    wide = signs.astype(np.int32)
    total = np.zeros(n)
    for (j, k), weight in zip(OFFSETS, WEIGHTS):
        code = (wide[:n] << (2 * SIGNS_BITS)) | (wide[j : n + j] << SIGNS_BITS) | wide[k : n + k]
        total += weight * table[code]
    # Added up place by place: differences of running sums would not be 0 for gaps alone.
    return sum(total[i : n + 1 - STRETCH + i] for i in range(STRETCH))


def _meeting(signs: np.ndarray, n: int, apart: int) -> np.ndarray:
    """Products of counts, added up where a subsequence from a place and one from ``apart`` on are equal."""
    at = np.flatnonzero(signs[:n] == signs[apart : n + apart]) if apart else slice(0, n)
    reach, ones = range(1, REACH), np.uint8
    one = {k: signs[k : n + k][at] for k in reach}
    two = {k: signs[apart + k : n + apart + k][at] for k in reach}
    letter = (signs[:n][at] != GAP).view(ones)
    letters = {k: (one[k] != GAP).view(ones) for k in reach}
    zero = np.zeros(len(letter), dtype=ones)
    # Of each pair of third signs, the pairs of second signs before it that are equal: letters, and all.
    before = {(k, m): (zero, zero) for k in range(REACH) for m in range(REACH) if not k or not m}
    total: dict[int, np.ndarray] = {}
    for k in reach:
        for m in reach:
            same = (one[k] == two[m]).view(ones)
            least, most = before[k - 1, m - 1]
            if k > 1 and m > 1:
                # With one letter in first and third sign the second needs none, else it is one.
                both = letter & letters[k]
                fit = (least * (letter ^ letters[k]) + most * both) * same
                total[k + m] = total[k + m] + fit if k + m in total else fit
            up, left = before[k - 1, m], before[k, m - 1]
            before[k, m] = (up[0] + left[0] - least + (same & letters[k]), up[1] + left[1] - most + same)
    met = np.zeros(len(letter))
    for ends, count in total.items():
        met += DECAY ** (ends - 4) * count
    if not apart:
        return met
    found = np.zeros(n)
    found[at] = met
    return found


def all_norms(signs: np.ndarray) -> np.ndarray:
    """Lengths of the counts of the stretch from each place on, as ``norms`` has them."""
    n = len(signs) - REACH
    out = np.empty(n + 1 - STRETCH)
    for first in range(0, len(out), PLACES):
        size = min(PLACES, len(out) - first)
        some = signs[first : first + size + STRETCH + REACH - 1]
        inside = size + STRETCH - 1
        # Of each place, the products with those up to ``apart`` places on.
        reached, squares = np.zeros(inside), np.zeros(size)
        for apart in range(STRETCH):
            met = _meeting(some, inside - apart, apart)
            reached[: inside - apart] += 2 * met if apart else met
            squares += reached[STRETCH - 1 - apart : STRETCH - 1 - apart + size]
        out[first : first + size] = np.sqrt(squares)
    return out + 1e-12


def _counting() -> np.ndarray:
    """Which codes have two letters at least."""
    code, mask = np.arange(CODES), (1 << SIGNS_BITS) - 1
    letters = sum(((code >> (SIGNS_BITS * k)) & mask) != GAP for k in range(3))
    return letters >= 2


def stretch_counts(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of stretches (rows of STRETCH + REACH - 1 signs), and their counts."""
    wide = stretches.astype(np.int32)
    parts = []
    for j, k in OFFSETS:
        first, second, third = (wide[:, a : a + STRETCH] for a in (0, j, k))
        parts.append((first << (2 * SIGNS_BITS)) | (second << SIGNS_BITS) | third)
    codes = np.concatenate(parts, axis=1)
    counting = worker_state("toxicity-counting", _counting)
    return codes, np.where(counting[codes], np.repeat(np.array(WEIGHTS), STRETCH), 0.0)


def norms(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Lengths of the counts of stretches, where a code may occur several times."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered, counts = np.take_along_axis(codes, order, axis=1), np.take_along_axis(counts, order, axis=1)
    change = np.ones(codes.shape, dtype=bool)
    change[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    sums = np.add.reduceat(counts.ravel(), np.flatnonzero(change.ravel()))
    row = np.repeat(np.arange(len(codes)), change.sum(axis=1))
    return np.sqrt(np.bincount(row, sums**2, len(codes))) + 1e-12


def decisions(stretches: np.ndarray, table: np.ndarray, offset: float) -> np.ndarray:
    """Values of the machine: the folded kernel sum over the norm, and the offset."""
    codes, counts = stretch_counts(stretches)
    return (table[codes] * counts).sum(axis=1) / norms(codes, counts) + offset


def best_stretches(
    values: list[str], table: np.ndarray, offset: float, taken: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``taken`` stretches of each text with the largest values: text, value, signs.

    Every stretch is valued. The first is the best of the text, each further one the best of
    those that overlap none before.
    """
    signs, starts, ends = signs_of(values)
    level = responses(signs, np.where(worker_state("toxicity-counting", _counting), table, 0.0))
    level /= all_norms(signs)
    of, places = [], []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        mine = level[a:b]
        for _ in range(taken):
            at = int(np.argmax(mine))
            if mine[at] == -np.inf:
                break
            of.append(i)
            places.append(a + at)
            mine[max(0, at - STRETCH) : at + STRETCH] = -np.inf
    of = np.array(of, dtype=np.int64)
    rows = signs[np.array(places, dtype=np.int64)[:, None] + np.arange(STRETCH + REACH - 1)]
    return of, decisions(rows, table, offset), rows


def sliced(values: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``SLICE`` characters each."""
    start, size = 0, 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label each subsequence occurs."""
    counts = np.zeros((2, CODES), dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            wide = signs_of([text])[0].astype(np.int32)
            n = len(wide) - REACH
            seen = np.zeros(CODES, dtype=bool)
            for j, k in OFFSETS:
                seen[(wide[:n] << (2 * SIGNS_BITS)) | (wide[j : n + j] << SIGNS_BITS) | wide[k : n + k]] = True
            counts[label] += seen
    label, code = np.nonzero(counts)
    columns = [pa.array(label, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[label, code])]
    yield pa.RecordBatch.from_arrays(columns, names=["label", "code", "n"])


def first_table(docs: DataFrame) -> np.ndarray | None:
    """Log odds of each subsequence by the documents it occurs in; None without both labels."""
    rows = dict(docs.groupBy("label").count().collect())
    if len(rows) < 2:
        return None
    found = docs.select("text", "label").mapInArrow(_occurring, "label int, code int, n long")
    counts = np.zeros((2, CODES))
    for label, code, n in found.groupBy("label", "code").agg(F.sum("n")).collect():  # at most 2 x CODES rows
        counts[label, code] = n
    pull = 5.0 * rows[0] / rows[1]
    toxic = np.log((counts[1] + 5.0) / (rows[1] + 50.0))
    odds = toxic - np.log((counts[0] + pull) / (rows[0] + 10.0 * pull))
    return np.where(_counting(), odds, 0.0)


def mined(docs: DataFrame, table: np.ndarray, offset: float) -> tuple[np.ndarray, ...]:
    """Best stretches of the training documents: document, label, value and signs of each."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = batch.column(1).to_pylist()
            for a, b in sliced(values):
                of, value, rows = best_stretches(values[a:b], sent.value, offset, TAKEN)
                columns = [ids[a:b][of], labels[a:b][of], value]
                signs = pa.array([row.tobytes() for row in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), signs], names=["doc_id", "label", "value", "signs"]
                )

    kind = "doc_id long, label int, value double, signs binary"
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text", "label").mapInArrow(run, kind).collect())
    # At most TAKEN stretches of TRAIN_ROWS documents.
    signs = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    return tuple(np.array([r[k] for r in rows]) for k in range(3)) + (signs,)


def _products(codes: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Kernels, short of norms, of stretches with landmarks given as dense counts (codes x landmarks)."""
    found = np.zeros((len(codes), dense.shape[1]))
    for i in range(0, len(codes), 512):
        found[i : i + 512] = np.einsum("nck,nc->nk", dense[codes[i : i + 512]], counts[i : i + 512], optimize=True)
    return found


def landmarks_of(codes: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int) -> np.ndarray:
    """Stretches that lie far from each other, most of them toxic: indices."""
    rng = np.random.default_rng(seed)
    lengths, chosen = norms(codes, counts), []
    for label, many in ((1, LANDMARKS * 5 // 8), (0, LANDMARKS * 3 // 8)):
        some = np.flatnonzero(labels == label)
        if len(some) > 2000:
            some = np.sort(rng.choice(some, 2000, replace=False))
        near = np.full(len(some), -np.inf)
        at = 0
        for _ in range(min(many, len(some))):
            chosen.append(int(some[at]))
            dense = np.zeros(CODES)
            np.add.at(dense, codes[some[at]], counts[some[at]])
            like = (dense[codes[some]] * counts[some]).sum(axis=1) / (lengths[some] * lengths[some[at]])
            near = np.maximum(near, like)
            at = int(np.argmin(near))
            if near[at] > 0.999:
                break
    return np.array(chosen)


def machine(stretches: np.ndarray, labels: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Table of weights per subsequence and offset of the support vector machine."""
    codes, counts = stretch_counts(stretches)
    marks = landmarks_of(codes, counts, labels, seed)
    lengths = norms(codes, counts)
    dense = np.zeros((CODES, len(marks)))
    for column, i in enumerate(marks):
        np.add.at(dense[:, column], codes[i], counts[i] / lengths[i])
    kernel = _products(codes, counts, dense) / lengths[:, None]
    values, vectors = np.linalg.eigh(kernel[marks])
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    x = np.column_stack([kernel @ root, np.ones(len(codes))])
    y = np.where(labels == 1, 1.0, -1.0)
    cost = COST * np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    pull = np.ones(x.shape[1])
    pull[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON):  # squared hinge loss: exact steps on the rows inside the margin
        inside = y * (x @ w) < 1
        left = x[inside] * cost[inside, None]
        new = np.linalg.solve(left.T @ x[inside] + np.diag(pull), left.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return dense @ (root @ w[:-1]), float(w[-1])


def calibrated(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and base that turn values into chances (smoothed targets).

    The rarer label weighs more, by the root of how much rarer it is: half way between
    chances at the labels' own rate and at equal rates.
    """
    ones, noes = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (noes + 2))
    weight = np.where(labels == 1, (noes / max(ones, 1)) ** 0.5, 1.0)
    mean, width = values.mean(), values.std() + 1e-9
    x = np.column_stack([(values - mean) / width, np.ones(len(values))])
    w = np.zeros(2)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-(x @ w)))
        bend = x.T @ (x * (weight * chance * (1 - chance))[:, None]) + 1e-6 * np.eye(2)
        w -= np.linalg.solve(bend, x.T @ (weight * (chance - target)))
    return float(w[0] / width), float(w[1] - w[0] * mean / width)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 3) -> dict:
    """Fit on at most ``rows`` labelled documents whose id's CRC-32 leaves a rest other than 1 by 3.

    Documents are labelled, stretches are not: a round takes the best stretches of each
    document by the table so far. Those of toxic documents are the positives of the round;
    those of clean documents stay negatives in all later rounds. A fifth of the documents
    only calibrates. Without both labels all scores are the smoothed share of toxic ones.
    """
    wanted = training_labels(labels, "toxic", held_out(3, 1), rows)
    some = texts(docs).join(F.broadcast(wanted), "doc_id")  # at most `rows` ids
    some = materialize(some.select("doc_id", "text", "label"), "toxicity-training")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0
    fitted, kept = some.where(~part), some.where(part)
    table = first_table(fitted)
    if table is None or kept.select("label").distinct().count() < 2:
        ones, total = some.where("label = 1").count(), some.count()
        chance = (ones + 1) / (total + 2)
        return {"table": np.zeros(CODES), "offset": 0.0, "slope": 0.0, "base": float(np.log(chance / (1 - chance)))}
    clean, offset = [], 0.0
    for turn in range(ROUNDS):
        _, label, _, signs = mined(fitted, table, offset)
        toxic = np.unique(signs[label == 1], axis=0)
        clean.append(signs[label == 0])
        negative = np.unique(np.concatenate(clean), axis=0)
        target = np.concatenate([np.ones(len(toxic)), np.zeros(len(negative))])
        table, offset = machine(np.concatenate([toxic, negative]), target, seed + turn)
    ids, label, value, _ = mined(kept, table, offset)
    last = np.append(ids[1:] != ids[:-1], True)  # rows of a document are ordered by value
    values, label = value[last], label[last]
    slope, base = calibrated(values, label)
    return {"table": table, "offset": offset, "slope": slope, "base": base}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores come from the whole text alone. A null or empty text, or one without letters, is
    a stretch of gaps and has the score of that. Repeated rows and null ids are rows like any
    other; an empty table gives an empty result. Nothing is shuffled.
    """
    scored = texts(docs).select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", predicted)


def scorer(spark: SparkSession, model: dict):
    """The score of a text column as a function of Spark; texts pass through Arrow in batches."""
    sent = spark.sparkContext.broadcast(model)  # a table of CODES numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for batch in batches:
            values, found = ["" if v is None else v for v in batch], [np.zeros(0)]
            for a, b in sliced(values):
                _, value, _ = best_stretches(values[a:b], m["table"], m["offset"], 1)
                found.append(1 / (1 + np.exp(-np.clip(m["slope"] * value + m["base"], -700, 700))))
            yield pd.Series(np.concatenate(found))

    return F.pandas_udf(run, "double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score at ``threshold`` or above, all columns as they are."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(names[docs.columns.index("text")]).cast("string"), F.lit(""))
    rows = docs.toDF(*names).withColumn("_score", scorer(docs.sparkSession, model)(text))
    return rows.where(F.col("_score") < threshold).select(*names).toDF(*docs.columns)
