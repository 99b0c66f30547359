"""Vocabulary ids of whole texts by array work on their bytes.

Texts are cut into pieces as the vocabulary's own pattern does (classes of characters are
asked of the library once), pieces are hashed by running sums, and only pieces that a
worker has not met go to an encoder. Hashes have 64 bits and random letters' values.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from faultline.llm.common import worker_state

# Classes of characters.
LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3
# Bytes of text worked on at once, and pieces that a worker keeps before it starts anew.
SLICE, KEPT = 1 << 19, 400_000
SLOTS = 20

_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def character_classes() -> bytes:
    """The class of each code point by the library's patterns, packed. Run on the driver."""
    return worker_state("character-classes", _ask_library)


def _ask_library() -> bytes:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        for i in range(0, len(points), 1 << 14):
            some = points[i : i + (1 << 14)]
            found = np.ones(len(some), dtype=bool)
            for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str("".join(map(chr, some))):
                found[a:b] = False
            kinds[np.array(some)[found]] = kind
    return zlib.compress(kinds.tobytes())


class Powers:
    """Powers of the step of the running hash and of its inverse."""

    def __init__(self):
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
            self.up = np.cumprod(np.full(n, _STEP, dtype=np.uint64))
            self.down = np.cumprod(np.full(n, inverse, dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span of bytes, wherever it stands."""
    if len(powers.up) < len(data) + 1:
        powers.grow(2 * len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers.up[: len(data)], out=sums[1:])
    spans = (sums[ends] - sums[starts]) * powers.down[starts]
    return mixed(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Seen:
    """Ids of the pieces a worker has met, found by hash."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOTS, dtype=np.uint64)
        self.place = np.zeros(1 << SLOTS, dtype=np.int32)
        self.beside: dict[int, int] = {}
        self.count, self.used = 0, 0
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype=np.uint32)

    def add(self, keys: np.ndarray, ids: list) -> np.ndarray:
        """Places of new pieces."""
        n, sizes = len(keys), np.fromiter(map(len, ids), dtype=np.int64, count=len(keys))
        while self.count + n > len(self.first):
            self.first, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.sizes))
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = [i for piece in ids for i in piece]
        places = np.arange(self.count, self.count + n)
        self.sizes[places] = sizes
        self.first[places] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = self.count + n, self.used + total
        slots = (keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        free = self.keys[slots] == 0
        _, one = np.unique(slots, return_index=True)
        alone = np.zeros(n, dtype=bool)
        alone[one] = True
        free &= alone
        self.keys[slots[free]], self.place[slots[free]] = keys[free], places[free]
        self.beside.update(zip(keys[~free].tolist(), places[~free].tolist()))
        return places

    def find(self, keys: np.ndarray, encode: Callable[[np.ndarray], list]) -> np.ndarray:
        """Places of pieces; ``encode`` gets an index of each new piece and returns their ids."""
        slots = (keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        places = np.where(self.keys[slots] == keys, self.place[slots], -1).astype(np.int64)
        missed = np.flatnonzero(places < 0)
        if len(missed):
            others, at, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            found = np.fromiter((self.beside.get(k, -1) for k in others.tolist()), np.int64, len(others))
            new = np.flatnonzero(found < 0)
            if len(new):
                found[new] = self.add(others[new], encode(missed[at[new]]))
            places[missed] = found[back]
        return places

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and how many each has."""
        sizes = self.sizes[places]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[places] - before, sizes) + np.arange(int(sizes.sum()))
        return self.pool[at], sizes


_CUT = " "


def slices(text: str, most: int = SLICE) -> list[str]:
    """A long text in parts that begin with a space between two characters that are none."""
    parts, start = [], 0
    while len(text) - start > most:
        at = start + most
        while at < len(text) - 1 and not (text[at] == _CUT and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at += 1
        if at >= len(text) - 1:
            break
        parts.append(text[start:at])
        start = at
    return [*parts, text[start:]]


class Layout:
    """Bytes of texts side by side, with the class of each character."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        joined = "".join(texts)
        self.data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        self.points, self.kinds = points, classes[points]
        #: First byte of each character, and the end.
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.at = np.append(lead, len(self.data))
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths)
        self.first = np.zeros(len(points) + 1, dtype=bool)
        self.first[self.ends - lengths] = True
        self.first[-1] = True

    def shortened(self, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an apostrophe opens 's 't 'm 'd 're 've 'll, and how long that is."""
        at = opens[self.points[opens] == 0x27]
        size = np.zeros(len(at), dtype=np.int64)
        pad = np.append(self.points, [0, 0, 0]).astype(np.int64)
        inside = np.append(~self.first, [False, False, False])
        a, b = np.where(inside[at + 1], pad[at + 1], 0), np.where(inside[at + 1] & inside[at + 2], pad[at + 2], 0)
        size[np.isin(a, [ord(c) for c in "stmd"])] = 2
        for pair in ("re", "ve", "ll"):
            size[(a == ord(pair[0])) & (b == ord(pair[1]))] = 3
        return at[size > 0], size[size > 0]


def spaced_pieces(layout: Layout) -> np.ndarray:
    """Starts of byte-level pieces: a space belongs to what stands behind it."""
    kinds, n = layout.kinds, len(layout.kinds)
    start = layout.first.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    blank = kinds == SPACE
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~layout.first[1:n]) if n else np.zeros(0, dtype=np.int64)
    start[last] = True
    start[last[layout.points[last] == 0x20] + 1] = False
    return _with_shortened(layout, start)


def lone_pieces(layout: Layout) -> np.ndarray:
    """Starts of words, single digits, runs of signs, and runs of blanks."""
    kinds, n = layout.kinds, len(layout.kinds)
    start = layout.first.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    start[:n] |= kinds == DIGIT
    return _with_shortened(layout, start)


def _with_shortened(layout: Layout, start: np.ndarray) -> np.ndarray:
    n = len(layout.kinds)
    at, size = layout.shortened(np.flatnonzero(start[:n] & (layout.kinds == OTHER)))
    start[at + 1] = False
    start[at + size] = True
    return start


class ArrayEncoder:
    """Ids of texts through ``Seen``; a subclass says how texts are cut and pieces encoded."""

    def __init__(self, classes: bytes, added: dict[str, int]):
        import re

        self.classes = np.frombuffer(zlib.decompress(classes), dtype=np.uint8)
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.seen, self.powers = Seen(), Powers()

    def prepared(self, text: str) -> str:
        return text

    def cut(self, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and a mark of each piece, in order."""
        raise NotImplementedError

    def encode_new(self, data: np.ndarray, starts: list[int], ends: list[int], marks: list[int]) -> list:
        """Ids of pieces not met before."""
        raise NotImplementedError

    def _side_by_side(self, parts: list[str]) -> list[np.ndarray]:
        layout = Layout(parts, self.classes)
        starts, ends, marks = self.cut(layout)
        if self.seen.count > KEPT:
            self.seen.clear()
        keys = hashes(layout.data, starts, ends, self.powers) ^ mixed(marks.astype(np.uint64))
        if len(self.powers.up) > 8 * SLICE:
            self.powers.grow(1 << 16)  # a giant text leaves no giant tables behind

        def new(at: np.ndarray) -> list:
            return self.encode_new(layout.data, starts[at].tolist(), ends[at].tolist(), marks[at].tolist())

        ids, sizes = self.seen.ids(self.seen.find(keys, new))
        before = np.concatenate([[0], np.cumsum(sizes)])
        bounds = before[np.searchsorted(starts, layout.at[layout.ends])]
        return np.split(ids, bounds[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, special tokens' strings as their ids."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, int, str]] = []
        size = 0

        def work() -> None:
            for (i, place, _), ids in zip(waiting, self._side_by_side([w[2] for w in waiting])):
                found[i][place] = ids
            waiting.clear()

        for i, text in enumerate(texts):
            spans = self.split.split(text) if self.split and "<" in text else [text]
            for span in spans:
                if span in self.added:
                    found[i].append(np.array([self.added[span]], dtype=np.uint32))
                    continue
                for part in slices(self.prepared(span)):
                    if part:
                        waiting.append((i, len(found[i]), part))
                        found[i].append(None)
                        size += len(part)
                        if size >= SLICE:
                            work()
                            size = 0
        if waiting:
            work()
        none = np.zeros(0, dtype=np.uint32)
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else none for ids in found]
