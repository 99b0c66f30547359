"""Secrets in texts: fixed patterns, and a character network over every other candidate.

Findings of the patterns are the labelled positives, other long runs with a digit the
negatives. The network sees a candidate whole, and some characters on both sides of it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import texts
from faultline.session import checkpoint, materialize

KINDS = ("assign", "access", "hex", "net")
# The base patterns. A run of a class is whole or too short, so the least
# length of the last two stands in the pattern; a short assigned value uses up its text.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, ASSIGNED = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", 6
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Characters beside a candidate that the network sees.
BEFORE, AFTER = 24, 8
# Findings that a task fits between two averages of the networks, and tasks at most: each
# sends its network, some thousand numbers, to the driver. All findings take part.
SHARE, TASKS = 8192, 256
# Characters that are fitted at once of a longer candidate; it is fitted piece by piece.
PIECE = 4096
# The least share of the known findings on the validation part that a threshold must keep.
RECALL = 0.98
SYMBOLS, EMBED, WIDTH, FILTERS = 97, 8, 5, 24
EPOCHS, RATE, GROUP = 12, 0.01, 64
SPAN = "struct<kind:int,start:int,end:int>"
CANDIDATES = "array<struct<start:int,end:int,before:string,value:string,after:string,known:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping per kind."""
    found = [(0, *m.span()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= ASSIGNED]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """Long runs with a digit, what stands beside them, and whether a base span has them.

    ``known`` is true of a run inside a base span and null of one that goes on beyond it: that
    one is scored as a whole and labels nothing.
    """
    found = []
    for m in re.finditer(CANDIDATE, text):
        a, b = m.span()
        if re.search("[0-9]", m[0]):
            touched = [(s, e) for _, s, e in spans if s < b and a < e]
            known = any(s <= a and b <= e for s, e in touched) or (None if touched else False)
            found.append((a, b, text[max(0, a - BEFORE) : a], m[0], text[b : b + AFTER], known))
    return found


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("start", "end", "before", "value", "after", "known")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
    candidate = pa.list_(pa.struct(list(zip(names, kinds))))
    for batch in batches:
        spans, runs = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
            runs.append([dict(zip(names, c)) for c in candidates(text, base)])
        columns = [batch.column(0), pa.array(spans, span), pa.array(runs, candidate)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "runs"])


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, base, runs) of every whole text."""
    return texts(docs).mapInArrow(_extract, f"doc_id long, base array<{SPAN}>, runs {CANDIDATES}")


def coded(before: str, value: str, after: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a candidate in its surroundings, and which of them are its own."""
    raw = np.frombuffer((before.rjust(BEFORE)[-BEFORE:] + value + after.ljust(AFTER)).encode("utf-32-le"), "<u4")
    symbols = np.where((raw >= 32) & (raw < 127), raw - 31, 96).astype(np.int64)
    own = np.zeros(len(symbols), dtype=bool)
    own[BEFORE : BEFORE + len(value)] = True
    return symbols, own


PARTS = ("embed", "filters", "bias", "last", "base")


@dataclass
class Network:
    """Embedding, one convolution, pooling over candidate and surroundings, a logistic end."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    last: np.ndarray
    base: np.ndarray
    #: Calibration of the end's value, and the threshold on the calibrated score.
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (SYMBOLS, EMBED)),
            rng.normal(0, (WIDTH * (EMBED + 1)) ** -0.5, (WIDTH * (EMBED + 1), FILTERS)),
            np.zeros(FILTERS),
            rng.normal(0, 0.1, 3 * FILTERS),
            np.zeros(1),
        )

    def _forward(self, symbols: np.ndarray, own: np.ndarray) -> tuple:
        """Of one group padded to one length: symbols 0 are padding."""
        n, length = symbols.shape
        x = np.concatenate([self.embed[symbols] * (symbols > 0)[..., None], own[..., None]], axis=2)
        padded = np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        seen = np.lib.stride_tricks.sliding_window_view(padded, WIDTH, axis=1)
        seen = np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(n, length, -1)
        act = np.maximum(seen @ self.filters + self.bias, 0)
        inside, beside = act * own[..., None], act * ((symbols > 0) & ~own)[..., None]
        count = own.sum(axis=1, keepdims=True)
        pooled = np.concatenate([inside.max(axis=1), inside.sum(axis=1) / count, beside.max(axis=1)], axis=1)
        return seen, act, inside, beside, count, pooled, pooled @ self.last + self.base

    def values(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The uncalibrated value of each candidate, whatever its length."""
        found = np.zeros(len(rows))
        order = np.argsort([len(s) for s, _ in rows], kind="stable")
        for k in range(0, len(order), GROUP):
            some = order[k : k + GROUP]
            if len(rows[some[-1]][0]) > 4096:  # a very long run on its own, not padded beside others
                for i in some:
                    found[i] = self._forward(rows[i][0][None], rows[i][1][None])[-1][0]
            else:
                found[some] = self._forward(*padded_group([rows[i] for i in some]))[-1]
        return found

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.values(rows) + self.shift)))

    def moments(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in PARTS}

    def train(self, rows: list, labels: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        memory, turn = self.moments(), 0
        for _ in range(EPOCHS):
            turn = self.epoch(rows, labels, weight, rng, memory, turn)

    def epoch(
        self, rows: list, labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, memory: dict, turn: int
    ) -> int:
        """One pass over some rows; ``memory`` and the number of steps go on from pass to pass."""
        names = PARTS
        if rows:
            order = rng.permutation(len(rows))
            for some in grouped(order, rows):
                turn += 1
                symbols, own = padded_group([rows[i] for i in some])
                seen, act, inside, beside, count, pooled, value = self._forward(symbols, own)
                off = weight[some] * (1 / (1 + np.exp(-value)) - labels[some]) / len(some)
                back = off[:, None] * self.last
                into = own[..., None] * (back[:, FILTERS : 2 * FILTERS] / count)[:, None, :]
                line = np.arange(len(some))[:, None]
                for part, grad in ((inside, back[:, :FILTERS]), (beside, back[:, 2 * FILTERS :])):
                    np.add.at(into, (line, part.argmax(axis=1), np.arange(FILTERS)[None, :]), grad)
                into *= act > 0
                grads = {
                    "filters": np.einsum("nlw,nlf->wf", seen, into, optimize=True),
                    "bias": into.sum(axis=(0, 1)),
                    "last": pooled.T @ off,
                    "base": np.array([off.sum()]),
                }
                spread = (into @ self.filters.T).reshape(*symbols.shape, WIDTH, EMBED + 1)[..., :EMBED]
                moved = np.zeros((len(some), symbols.shape[1] + WIDTH - 1, EMBED))
                for w in range(WIDTH):
                    moved[:, w : w + symbols.shape[1]] += spread[:, :, w]
                moved = moved[:, WIDTH // 2 : WIDTH // 2 + symbols.shape[1]] * (symbols > 0)[..., None]
                grads["embed"] = np.zeros_like(self.embed)
                np.add.at(grads["embed"], symbols.ravel(), moved.reshape(-1, EMBED))
                for name in names:
                    one, two = memory[name]
                    one += 0.1 * (grads[name] - one)
                    two += 0.001 * (grads[name] ** 2 - two)
                    step = RATE * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.999**turn)) + 1e-8)
                    setattr(self, name, getattr(self, name) - step)
        return turn


def grouped(order: np.ndarray, rows: list) -> Iterator[np.ndarray]:
    """Rows that are fitted together; those longer than 512 characters each on their own."""
    for k in range(0, len(order), GROUP):
        some = order[k : k + GROUP]
        long = np.array([len(rows[i][0]) > 512 + BEFORE + AFTER for i in some])
        if not long.all():
            yield some[~long]
        yield from (some[i : i + 1] for i in np.flatnonzero(long))


def padded_group(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    length = max(len(s) for s, _ in rows)
    symbols, own = np.zeros((len(rows), length), dtype=np.int64), np.zeros((len(rows), length), dtype=bool)
    for i, (s, o) in enumerate(rows):
        symbols[i, : len(s)], own[i, : len(o)] = s, o
    return symbols, own


def variants(before: str, value: str, after: str, known: bool) -> list[tuple[str, str, str]]:
    """A finding as it is; a known one also in other surroundings and in capitals."""
    if not known:
        return [(before, value, after)]
    return [(before, value, after), ("", value, after), (before, value.upper(), after), ("", value.upper(), "")]


def fit(findings: DataFrame | list[tuple[int, str, str, str, bool]], seed: int = 6) -> Network | None:
    """The network for (part, before, value, after, known); part 0 is for calibration.

    Without findings of both labels in both parts there is none, and nothing is added. A
    list is fitted here, a table where its rows lie.
    """
    if isinstance(findings, DataFrame):
        return fit_spread(findings, seed)
    sides: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
    for part, before, value, after, known in findings:
        rows, labels = sides[part == 0]
        for variant in variants(before, value, after, known):
            rows.append(coded(*variant))
            labels.append(float(known))
    if any(len(set(labels)) < 2 for _, labels in sides.values()):
        return None
    network = Network.fresh(seed)
    network.train(sides[False][0], np.array(sides[False][1]), seed)
    rows, labels = sides[True][0], np.array(sides[True][1])
    values = network.values(rows)
    # Smoothed targets keep the calibration finite where the parts are separable.
    ones, noes = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (noes + 2))
    mean, width = values.mean(), values.std() + 1e-9
    scaled, slope, base = (values - mean) / width, 1.0, 0.0
    for _ in range(2000):
        off = 1 / (1 + np.exp(-(slope * scaled + base))) - target
        slope, base = slope - 0.5 * (off * scaled).mean(), base - 0.5 * off.mean()
    network.scale, network.shift = slope / width, base - slope * mean / width
    scores = network.scores(rows)
    # The wanted share of known findings scores ``least`` or more. Between that and the
    # highest other score below, thresholds do the same on these rows; the middle is taken.
    kept = np.sort(scores[labels == 1])
    least = float(kept[int(np.floor((1 - RECALL) * len(kept)))])
    below = scores[(labels == 0) & (scores < least)].max(initial=0.0)
    network.threshold = (least + float(below)) / 2
    return network


def pieces(before: str, value: str, after: str) -> list[tuple[str, str, str]]:
    """A candidate as it is, or a long one as pieces that stand beside each other."""
    if len(value) <= PIECE:
        return [(before, value, after)]
    whole = before + value + after
    cuts = range(len(before), len(before) + len(value), PIECE)
    ends = [min(k + PIECE, len(before) + len(value)) for k in cuts]
    return [(whole[max(0, k - BEFORE) : k], whole[k:e], whole[e : e + AFTER]) for k, e in zip(cuts, ends)]


def fit_spread(findings: DataFrame, seed: int) -> Network | None:
    """``fit`` on all findings, by tasks: in each round every task goes on from the common
    network over its own findings, batch by batch, and the networks that result are averaged
    by their findings. Calibration and threshold are sums and ranks over all of part 0.
    """
    stored = materialize(findings, "secret-findings")
    counts = {(r.held, r.known): r["count"] for r in stored.groupBy((F.col("part") == 0).alias("held"), "known").count().collect()}
    if any(not counts.get((held, known)) for held in (False, True) for known in (False, True)):
        return None
    copies = len(variants("", "", "", True))
    ones, noes = copies * counts[False, True], counts[False, False]
    weights = (0.5 * (ones + noes) / noes, 0.5 * (ones + noes) / ones)
    tasks = min(TASKS, -(-(counts[False, True] + counts[False, False]) // SHARE))
    place = F.xxhash64("before", "value", "after", "known")
    dealt = stored.where("part <> 0").withColumn("_place", place).repartition(tasks, "_place")
    dealt = checkpoint(dealt.sortWithinPartitions("_place", "before", "value", "after", "known").drop("_place"))
    network, memory, turn = Network.fresh(seed), Network.fresh(seed).moments(), 0
    for number in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], network=network, memory=memory, turn=turn, number=number) -> Iterator[pa.RecordBatch]:
            task, seen = TaskContext.get().partitionId(), 0
            rng = np.random.default_rng((seed, number, task))
            for batch in batches:
                rows, labels, weight = [], [], []
                for before, value, after, known in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                    for variant in variants(before, value, after, known):
                        cut = pieces(*variant)
                        rows += [coded(*piece) for piece in cut]
                        labels += [float(known)] * len(cut)
                        weight += [weights[known] / len(cut)] * len(cut)
                turn = network.epoch(rows, np.array(labels), np.array(weight), rng, memory, turn)
                seen += batch.num_rows
            if seen:
                state = pickle.dumps(([getattr(network, k) for k in PARTS], [memory[k] for k in PARTS], turn))
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([seen]), pa.array([state])], names=["task", "seen", "state"])

        made = sorted(dealt.mapInArrow(run, "task long, seen long, state binary").collect())
        states, share = [pickle.loads(r.state) for r in made], np.array([r.seen for r in made], dtype=float)
        share /= share.sum()
        for i, name in enumerate(PARTS):
            setattr(network, name, sum(w * s[0][i] for w, s in zip(share, states)))
            memory[name] = tuple(sum(w * s[1][i][j] for w, s in zip(share, states)) for j in (0, 1))
        turn = max(s[2] for s in states)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for before, value, after, known in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                some = [coded(*variant) for variant in variants(before, value, after, known)]
                rows, labels = rows + some, labels + [known] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.bool_()), pa.array(network.values(rows))], names=["known", "value"])

    held = materialize(stored.where("part = 0").mapInArrow(score, "known boolean, value double"), "secret-values")
    calibrate(network, held)
    return network


def calibrate(network: Network, held: DataFrame) -> None:
    """Scale, shift and threshold from (known, value) of all rows of part 0, as ``fit`` has them."""
    first = held.agg(
        F.avg("value"), F.stddev_pop("value"), F.count_if("known"), F.count_if(~F.col("known"))
    ).first()
    mean, width, ones, noes = first[0], first[1] + 1e-9, first[2], first[3]
    # Smoothed targets keep the calibration finite where the parts are separable.
    target = F.when(F.col("known"), (ones + 1) / (ones + 2)).otherwise(1 / (noes + 2))
    x = (F.col("value") - mean) / width
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + F.exp(-(x * float(at[0]) + float(at[1]))))
        off, bend = p - target, p * (1 - p)
        terms = (off * x, off, bend * x * x, bend * x, bend)
        a, b, c, d, e = held.select(*[t.alias(f"t{i}") for i, t in enumerate(terms)]).agg(*[F.avg(f"t{i}") for i in range(5)]).first()
        step = np.linalg.solve(np.array([[c, d], [d, e]]) + 1e-9 * np.eye(2), [a, b])
        at = at - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    network.scale, network.shift = float(at[0]) / width, float(at[1]) - float(at[0]) * mean / width
    scores = held.select("known", (1 / (1 + F.exp(-(F.col("value") * network.scale + network.shift)))).alias("score"))
    # The wanted share of known findings scores ``least`` or more. Between that and the
    # highest other score below, thresholds do the same on these rows; the middle is taken.
    least = ranked(scores.where("known"), "score", int(np.floor((1 - RECALL) * ones)))
    below = scores.where(~F.col("known") & (F.col("score") < least)).agg(F.max("score")).first()[0]
    network.threshold = (least + (below or 0.0)) / 2


def ranked(rows: DataFrame, column: str, place: int, few: int = 10_000, bins: int = 1000) -> float:
    """The value at a place (from 0) of the ascending order, by counts of ever narrower bins."""
    value = F.col(column)
    while True:
        low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
        if low == high:
            return low
        if n <= few:
            return sorted(r[0] for r in rows.select(value).collect())[place]
        width = (high - low) / bins
        number = F.least(F.floor((value - low) / width), F.lit(bins - 1))
        counted = rows.groupBy(number.alias("bin")).count().orderBy("bin").collect()
        if len(counted) == 1:  # too narrow for doubles to tell apart
            return low
        for r in counted:
            if place < r["count"]:
                rows = rows.where(number == r.bin)
                break
            place -= r["count"]


def training_findings(found: DataFrame) -> DataFrame:
    """(part, before, value, after, known) of all labelled findings; repeated ones count once."""
    rows = found.select(F.explode("runs").alias("r")).select("r.before", "r.value", "r.after", "r.known")
    rows = rows.where("known IS NOT NULL").distinct()
    part = F.crc32(F.col("value").cast("binary")) % 4
    return rows.select(part.cast("int").alias("part"), "before", "value", "after", "known")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end; code points, end exclusive).

    Base spans are all there; ``net`` spans are candidates that lie in none, though they may
    hold one, and that the network scores at its threshold or above. Spans are ordered by start, then by kind as in
    ``KINDS``. Null and empty texts have no spans; repeated rows and null ids are rows like
    any other; an empty table gives an empty result. Texts are read whole and once: what is
    found in them is stored, the network is fitted on all of its
    findings by tasks, and scores the rest where it lies.
    """
    found = materialize(extracted(docs), "secret-candidates")
    model = fit(training_findings(found))  # some thousand numbers, sent with the function
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [(i, c) for i, cs in enumerate(runs) for c in cs if model is not None and not c["known"]]
            scores = model.scores([coded(c["before"], c["value"], c["after"]) for _, c in new]) if new else []
            for (i, c), score in zip(new, scores):
                if score >= model.threshold:
                    base[i].append({"kind": 3, "start": c["start"], "end": c["end"]})
            for spans in base:
                spans.sort(key=lambda s: (s["start"], s["kind"]))
                for s in spans:
                    s["kind"] = KINDS[s["kind"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digests(spans: DataFrame) -> DataFrame:
    """Counts and joined spans of each document."""

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(chosen):
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "net")
    counts = [count(kind) for kind in KINDS[:3]]
    return spans.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


MASK = "[secret]"


def masked_text(text: str, model: Network | None) -> str:
    """A text with its spans replaced; the network adds what it scores at its threshold."""
    spans = base_spans(text)
    new = [c for c in candidates(text, spans) if not c[5]] if model is not None else []
    scores = model.scores([coded(*c[2:5]) for c in new]) if new else []
    spans += [(3, c[0], c[1]) for c, score in zip(new, scores) if score >= model.threshold]
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``MASK``; spans that overlap as one.

    n_chars, where there is such a column, is counted anew for a text that changes. Rows
    stay where they are: candidates are stored for the network alone.
    """
    model = fit(training_findings(materialize(extracted(docs), "secret-candidates")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")])

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else masked_text(v, model) for v in values], dtype=object)

    rows = docs.toDF(*names).withColumn("_text", F.pandas_udf(run, "string")(text))
    chosen = []
    for name, field in zip(names, docs.schema):
        value = F.col("_text") if field.name == "text" else F.col(name)
        if field.name == "n_chars":
            value = F.when(F.col("_text") != text, F.char_length("_text").cast(field.dataType)).otherwise(value)
        chosen.append(value.alias(name))
    return rows.select(*chosen).toDF(*docs.columns)
