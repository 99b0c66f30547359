"""Personal data in texts: fixed patterns, and what weak labelers agree on besides.

Loose patterns propose spans. Six labelers vote on each or abstain: patterns, layout,
gazetteers, words in front, neighbours, and repetition. Nobody has labelled the spans, so
expectation-maximisation finds how far each labeler can be trusted from how often which
votes meet, and with that how likely a span is personal. A classifier over layout and
surroundings is fitted to these likelihoods and decides on every proposed span that the
fixed patterns do not have.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import texts
from faultline.session import materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A match begins where a run of its first class begins, so
# a look-behind keeps long runs from being tried from each of their places.
DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS, PART = (16, 19), (8, 15), 255
# What may be personal data besides.
SPELLED = (
    r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]{1,63})+"
)
SPELLED_SIGN = r"[\[(]\x20?(?:at|AT|@)\x20?[\])]"
GROUPS6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
NUMBER = r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9])+"
# Gazetteers: ends of domains, first digits of card issuers, calling codes of countries.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz eu de fr es it uk us ca nl be ch at se no dk fi pl pt ie cz gr ru cn jp in br "
    "mx ar au nz za kr tr il io co dev app me tv cc xyz online site tech cloud email".split()
)
ISSUERS = ("34", "37", "36", "38", "30", "4", "51", "52", "53", "54", "55", "2", "6011", "65", "62", "35", "50", "56", "57", "58", "63", "67")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420", "421")
# Words in front of a span that speak for its kind, and those that speak for another number.
SAYS = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt to at from".split()),
    "ip": frozenset("ip host server address addr node gateway client from".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta cc".split()),
    "phone": frozenset("tel phone call fax mobile cell telephone telefon handy dial contact at ring".split()),
}
DENIES = frozenset("order invoice id isbn issn version ver v release ticket ref no nr number sku token hash key serial build lot".split())
LABELERS = 6
ROUNDS = 60
# Candidates of each kind that the classifier is fitted to at most, in the order of a hash.
FITTED = 4000
# Cells of the classifier, and the probability from which a span is taken.
CELLS, ACCEPT = 1 << 12, 0.9
STEPS, RATE, DECAY = 300, 0.5, 1e-4
BEFORE, AFTER = 32, 8

SPAN = "struct<kind:int,start:int,end:int>"
RUN = "struct<kind:int,start:int,end:int,votes:int,cells:array<int>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_RUN = pa.struct([*_SPAN, pa.field("votes", pa.int32()), pa.field("cells", pa.list_(pa.int32()))])
_local = re.compile(r"[A-Za-z0-9._%+-]")
_compiled = {name: re.compile(p) for name, p in {
    "domain": DOMAIN, "ip": IP, "card": CARD, "phone": PHONE, "spelled": SPELLED, "sign": SPELLED_SIGN,
    "groups": GROUPS6, "number": NUMBER,
}.items()}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def in_range(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= PART


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each sign: what stands before it, not past the match before."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _local.match(text, start - 1):
            start -= 1
        match = _compiled["domain"].match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind as in ``KINDS``, then start."""
    found = [(0, *span) for span in emails(text)]
    for m in _compiled["ip"].finditer(text):
        if all(map(in_range, m[0].split("."))):
            found.append((1, *m.span()))
    for m in _compiled["card"].finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() <= 2 * CARD_DIGITS[1] else ""
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append((2, *m.span()))
    for m in _compiled["phone"].finditer(text):
        if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]:
            found.append((3, *m.span()))
    return found


def proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of everything that may be personal data, base spans apart."""
    if _compiled["sign"].search(text):
        for m in _compiled["spelled"].finditer(text):
            yield 0, *m.span()
    if ":" in text:
        for m in _compiled["groups"].finditer(text):
            yield 1, *m.span()
    for m in _compiled["number"].finditer(text):
        if m.end() - m.start() > 48:
            continue  # a table of figures, not one number
        value = m[0]
        n = len(digits_of(value))
        if value.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value):
            yield 1, *m.span()
            continue
        if 13 <= n <= 19 and value[0] not in "+(":
            yield 2, *m.span()
        if 7 <= n <= 15:
            yield 3, *m.span()


def layout(value: str) -> str:
    """Digits and letters as runs: ``(555) 123-4567`` is ``(3) 3-4``."""
    shape = re.sub(r"[0-9]+", lambda m: str(len(m[0])), value)
    return re.sub(r"[A-Za-z]+", "a", shape)


def votes(kind: int, value: str, before: str, after: str, base: bool) -> list[int]:
    """What each labeler says: 1 for, 2 against, 0 nothing."""
    digits, shape, name = digits_of(value), layout(value), KINDS[kind]
    six = kind == 1 and ":" in value
    # 1: the fixed pattern has it, or its check fails.
    failed = (kind == 1 and not six) or (kind == 2 and not luhn(digits))
    strict = 1 if base else 2 if failed else 0
    # 2: layout.
    if kind == 0:
        form = 1
    elif kind == 1:
        form = 1 if six or all(map(in_range, value.split("."))) else 2
    elif kind == 2:
        form = 1 if shape in ("15", "16", "4 4 4 4", "4-4-4-4", "4 6 5", "4-6-5", "14", "19") else 2
    else:
        apart = re.fullmatch(r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}([ .-][0-9]{2,4}){1,2}", value)
        form = 1 if apart or (value[0] == "+" and 8 <= len(digits) <= 15) else 2
    # 3: gazetteers.
    if kind == 0:
        known = 1 if re.split(r"[^A-Za-z0-9]+", value.rstrip(")]"))[-1].lower() in ENDINGS else 2
    elif kind == 1:
        first = "" if six else value.split(".")[0].lstrip("0")
        known = 1 if six or (len(first) <= 3 and 1 <= int(first or 0) <= 223) else 2
    elif kind == 2:
        known = 1 if digits.startswith(ISSUERS) else 2
    elif value[0] == "+":
        known = 1 if digits.startswith(CODES) else 2
    else:
        known = 0
    # 4: words in front.
    words = re.findall(r"[a-z-]+", before.lower())[-3:]
    context = 1 if SAYS[name] & set(words) else 2 if DENIES & set(words[-1:]) else 0
    # 5: neighbours.
    glued = (before[-1:].isalnum() or before[-1:] in tuple("_/=#-")) or (after[:1].isalnum() or after[:1] in tuple("_/="))
    beside = 2 if glued else 1
    # 6: repetition.
    varied = 0 if kind == 0 else 2 if len(set(digits)) <= 2 and not six else 1
    return [strict, form, known, context, beside, varied]


def cells_of(kind: int, value: str, before: str, after: str) -> list[int]:
    """Cells of the classifier: layout and surroundings, hashed together with the kind."""
    digits, shape = digits_of(value), layout(value)
    words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    said = [f"w{w}" for w in words] + [f"last{words[-1]}" if words else "first"]
    said += [f"shape{shape}", f"n{len(digits)}", f"len{min(len(value), 40) // 4}", f"luhn{luhn(digits)}"]
    said += [f"p{i}{shape[i : i + 2]}" for i in range(min(len(shape), 8))]
    said += [f"b{_class(before[-1:])}", f"a{_class(after[:1])}", f"both{_class(before[-1:])}{_class(after[:1])}"]
    said += [f"start{digits[:1]}", f"start{digits[:2]}", f"kinds{min(len(set(digits)), 4)}"]
    if kind == 0:
        said.append("end" + re.split(r"[^A-Za-z0-9]+", value)[-1].lower())
    if kind == 1:
        said.append(f"fits{all(map(in_range, value.split('.'))) if ':' not in value else 6}")
    return sorted({zlib.crc32(f"{kind} {s}".encode()) % CELLS for s in [*said, ""]})


def _class(c: str) -> str:
    return "end" if not c else "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind, start, end, votes, cells) of base spans and of proposed ones that no base span holds."""
    found = [(*span, True) for span in base]
    for kind, start, end in proposed(text):
        if not any(s <= start and end <= e for _, s, e in base):
            found.append((kind, start, end, False))
    out = []
    for kind, start, end, known in found:
        value, before, after = text[start:end][:128], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
        said = votes(kind, value, before, after, known)
        code = sum(v * 3**i for i, v in enumerate(said))
        out.append((kind, start, end, code, cells_of(kind, value, before, after)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, runs = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
            runs.append([dict(zip(("kind", "start", "end", "votes", "cells"), c)) for c in candidates(text, base)])
        columns = [batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(runs, pa.list_(_RUN))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "runs"])


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, base, runs) of every whole text; of the values themselves only hashes come out."""
    return texts(docs).mapInArrow(_extract, f"doc_id long, base array<{SPAN}>, runs array<{RUN}>")


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share, table, likelihoods) by expectation-maximisation over combinations of votes.

    ``table[y, labeler, vote]`` is how often a labeler says so of spans that are personal
    (y = 1) or not. The first guess is the majority; one count more of everything keeps
    all chances above zero.
    """
    said = (codes[:, None] // 3 ** np.arange(LABELERS)) % 3
    lead = (said == 1).sum(axis=1) - (said == 2).sum(axis=1)
    likely = 1 / (1 + np.exp(-lead.astype(float)))
    share, table = 0.5, np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        for y, weight in ((0, counts * (1 - likely)), (1, counts * likely)):
            for vote in range(3):
                table[y, :, vote] = 1 + ((said == vote) * weight[:, None]).sum(axis=0)
            table[y] /= table[y].sum(axis=1, keepdims=True)
        share = (1 + (counts * likely).sum()) / (2 + counts.sum())
        logs = np.log(table)[:, np.arange(LABELERS)[None, :], said].sum(axis=2)
        likely = 1 / (1 + np.exp(np.log(1 - share) + logs[0] - np.log(share) - logs[1]))
    return share, table, likely


@dataclass
class Model:
    #: Weight of each cell, and per kind the likelihood of each combination of votes.
    weights: np.ndarray
    likely: dict[int, dict[int, float]]

    def score(self, cells: list[list[int]]) -> np.ndarray:
        values = np.array([self.weights[c].sum() for c in cells])
        return 1 / (1 + np.exp(-values))


def fit_weights(rows: list[tuple[list[int], float]]) -> np.ndarray:
    """Logistic weights of the cells for (cells, likelihood), by full gradients with momentum."""
    at = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    cell = np.concatenate([c for c, _ in rows]).astype(np.int64)
    wanted = np.array([y for _, y in rows])
    weights, speed = np.zeros(CELLS), np.zeros(CELLS)
    often = np.sqrt(np.bincount(cell, minlength=CELLS) / len(rows)) + 1e-3
    for _ in range(STEPS):
        value = np.bincount(at, weights[cell], minlength=len(rows))
        off = 1 / (1 + np.exp(-value)) - wanted
        pull = np.bincount(cell, off[at], minlength=CELLS) / len(rows) / often + DECAY * weights
        speed = 0.9 * speed - RATE * pull
        weights = weights + speed
    return weights


def learn(found: DataFrame, fitted: int = FITTED) -> Model | None:
    """The model of what ``extracted`` gives; None where nothing was proposed.

    Votes are counted over all candidates: at most 3^6 combinations of each kind arrive.
    The classifier is fitted to ``fitted`` candidates of each kind at most.
    """
    runs = found.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    counts = runs.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    likely: dict[int, dict[int, float]] = {}
    for kind in sorted({r.kind for r in counts}):
        own = [r for r in counts if r.kind == kind]
        codes = np.array([r.votes for r in own])
        likely[kind] = dict(zip(codes.tolist(), reliabilities(codes, np.array([r.n for r in own], float))[2].tolist()))
    rows = []
    for kind in likely:
        some = runs.where(F.col("kind") == kind).select("votes", "cells").orderBy(
            F.xxhash64("doc_id", "start", "end"), "votes", "cells"
        )
        rows += [(list(r.cells), likely[kind][r.votes]) for r in some.limit(fitted).collect()]
    return Model(fit_weights(rows), likely) if rows else None


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, base; code points, end exclusive).

    Base spans are all there. Others are proposed spans that lie in no base span, pass their
    checksum or range, have votes that make them likelier personal than not, and get
    ``ACCEPT`` or more from the classifier. Spans are ordered by kind as in ``KINDS``, then by start. Null and empty texts have
    none; repeated rows and null ids are rows like any other; an empty table gives an empty
    result. Texts are read whole and once; what is stored of them are places and hashes.
    """
    found = materialize(extracted(docs), "personal-candidates")
    model = learn(found)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append([(s["kind"], s["start"], s["end"], True) for s in base] + accepted(base, runs, model))
            spans = [[dict(zip(("kind", "start", "end", "base"), (KINDS[s[0]], *s[1:]))) for s in sorted(o)] for o in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def accepted(base: list[dict], runs: list[dict], model: Model | None) -> list[tuple]:
    """Proposed spans to take. One that fails its own check (first labeler) only served to learn."""
    known = {(s["kind"], s["start"], s["end"]) for s in base}
    new = [r for r in runs if (r["kind"], r["start"], r["end"]) not in known and r["votes"] % 3 != 2]
    new = [r for r in new if model.likely[r["kind"]][r["votes"]] >= 0.5]
    scores = model.score([r["cells"] for r in new]) if new else []
    return [(r["kind"], r["start"], r["end"], False) for r, score in zip(new, scores) if score >= ACCEPT]


def digests(spans: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, and all spans of each document."""

    def joined(chosen):
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return spans.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
