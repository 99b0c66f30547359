"""Quality by a sparse ensemble of rules over statistics of a text.

Boosted trees of little depth are grown on the statistics of labelled texts; each path from
a root to a node is a rule, a conjunction of thresholds. A logistic model with an L1 penalty
keeps few of them, and what is left becomes one Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import BLANK, pick, texts

# Labelled texts that are fitted at most, taken in the order of a hash of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 64, 0.3
LEAST_ROWS = 5
PENALTY, STEPS = 5e-4, 1500
THRESHOLD = 0.3

# Characters that are counted, as classes of a regular expression.
COUNTED = {
    "capital": r"\p{Lu}",
    "digit": r"[0-9]",
    "stop": r"[.?]",
    "shout": r"!",
    "comma": r"[,;:]",
    "sign": r"[#$%&*@~^=_+<>{}\[\]\\]",
    "bar": r"[|/]",
    "blank": BLANK,
}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; shares of an empty one are 0."""
    points = F.char_length(text).cast("double")
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    found = {
        "points": points,
        "words": F.size(words).cast("double"),
        "word_points": share(points, F.size(words)),
        "other_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "other_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_points": share(points, F.size(lines)),
        "wide": share(F.octet_length(text), points),
    }
    for name, pattern in COUNTED.items():
        found[name] = share(points - F.char_length(F.regexp_replace(text, pattern, "")), points)
    return found


STATISTICS = ("points", "words", "word_points", "other_words", "other_lines", "line_points", "wide", *COUNTED)


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, threshold, whether it is above), and its weight."""

    terms: tuple[tuple[str, float, bool], ...]
    weight: float

    def holds(self) -> Column:
        found = F.lit(True)
        for name, limit, above in self.terms:
            found &= F.col(name) > limit if above else F.col(name) <= limit
        return found


@dataclass(frozen=True)
class Model:
    base: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.base)
        for rule in self.rules:
            total += F.when(rule.holds(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(bins: np.ndarray, rows: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[float, int, int]:
    """The best cut of some rows: gain, statistic, bin."""
    best = (1e-6, -1, -1)
    total, weight = slope[rows].sum(), bend[rows].sum()
    for k in range(bins.shape[1]):
        values = bins[rows, k]
        left = np.cumsum(np.bincount(values, slope[rows], BINS))[:-1]
        mass = np.cumsum(np.bincount(values, bend[rows], BINS))[:-1]
        count = np.cumsum(np.bincount(values, minlength=BINS))[:-1]
        gain = left**2 / (mass + 1) + (total - left) ** 2 / (weight - mass + 1) - total**2 / (weight + 1)
        gain[(count < LEAST_ROWS) | (len(rows) - count < LEAST_ROWS)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), k, at)
    return best


def grown_rules(values: np.ndarray, labels: np.ndarray, seed: int) -> list[tuple]:
    """Paths of boosted trees as tuples of (statistic, threshold, above), each once."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(values[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(values.shape[1])]
    bins = np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    logit = np.zeros(len(labels))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-logit))
        slope, bend = labels - chance, chance * (1 - chance)
        drawn = rng.random(len(labels)) < 0.5
        # Nodes to cut: their terms, all rows in them, and their depth.
        waiting = [((), np.arange(len(labels)), 0)]
        while waiting:
            terms, rows, depth = waiting.pop()
            cut = (0.0, -1, -1) if depth == DEPTH else _split(bins, rows[drawn[rows]], slope, bend)
            if cut[1] < 0:
                logit[rows] += RATE * slope[rows].sum() / (bend[rows].sum() + 1)
                continue
            _, k, at = cut
            for above in (False, True):
                path = (*terms, (STATISTICS[k], float(edges[k][min(at, len(edges[k]) - 1)]), above))
                rules[tuple(sorted(path))] = None
                waiting.append((path, rows[(bins[rows, k] > at) == above], depth + 1))
    return list(rules)


def fit(values: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """The model for labelled statistics; without both labels the share of ones, smoothed."""
    ones = float(labels.sum())
    prior = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    if ones in (0.0, float(len(labels))):
        return Model(prior, ())
    rules = grown_rules(values, labels, seed)
    place = {name: k for k, name in enumerate(STATISTICS)}
    facts = np.ones((len(labels), len(rules)), dtype=np.float64)
    for j, terms in enumerate(rules):
        for name, limit, above in terms:
            facts[:, j] *= (values[:, place[name]] > limit) == above
    # Rules that hold for the same rows say the same; one of them is enough.
    _, first = np.unique(facts, axis=1, return_index=True)
    first = np.sort(first[np.ptp(facts[:, first], axis=0) > 0])
    facts, rules = facts[:, first], [rules[j] for j in first]
    weights, base = np.zeros(len(rules)), prior
    step = 4.0 * len(labels) / (np.linalg.norm(np.column_stack([facts, np.ones(len(labels))]), 2) ** 2)
    ahead, ahead_base, pace = weights.copy(), base, 1.0
    for _ in range(STEPS):  # accelerated proximal steps
        off = 1 / (1 + np.exp(-(facts @ ahead + ahead_base))) - labels
        moved = ahead - step * (facts.T @ off) / len(labels)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_base = ahead_base - step * off.mean()
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = new + (pace - 1) / faster * (new - weights)
        ahead_base = new_base + (pace - 1) / faster * (new_base - base)
        weights, base, pace = new, new_base, faster
    kept = tuple(Rule(r, float(w)) for r, w in zip(rules, weights) if w != 0)
    return Model(float(base), kept)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document's label is kept from fitting; a null id counts as the empty text."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return key % modulus == remainder


def training_labels(labels: DataFrame, name: str, held: Column, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` documents that may be fitted, in a hash's order."""
    found = pick(labels, "doc_id", name, doc_id="long", **{name: "int"}).withColumnRenamed(name, "label")
    found = found.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held)
    # The larger label of an id that has several.
    found = found.groupBy("doc_id").agg(F.max("label").alias("label"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents whose id's CRC-32 leaves a rest other than 0 by 5."""
    wanted = training_labels(labels, "quality", held_out(5, 0), rows)
    some = texts(docs).join(F.broadcast(wanted), "doc_id")  # at most `rows` ids
    some = some.select("label", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    found = np.array([tuple(r) for r in some.collect()], dtype=np.float64).reshape(-1, len(STATISTICS) + 1)
    found = found[np.lexsort(found.T)]  # whatever order the rows came in
    return fit(found[:, 1:], found[:, 0])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores come from the whole text alone; null and empty texts have the statistics 0 and
    a score like any other. Repeated rows and null ids are rows like any other; an empty
    table gives an empty result. Everything stays in one pass of Spark expressions.
    """
    rows = texts(docs).select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    rows = rows.select("doc_id", held_out(5, 0).alias("held_out"), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
