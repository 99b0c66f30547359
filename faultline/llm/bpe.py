"""BPE with word ends: encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand side by side in no token of the vocabulary can't end up
in one token, whatever merges happen around them. So a word may be cut between them before
any merge: its fragments are encoded on their own and their ids put one after another.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import texts, worker_state
from faultline.llm.pieces import SPACE, ArrayEncoder, Layout, character_classes, lone_pieces

# Documents that a task hands on at once.
BATCH = 500
# Below this character composition and lower case are alike in all Unicode versions.
SURE = "\u0300"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class WordBpe(ArrayEncoder):
    """Ids as by the library's ``encode(text, add_special_tokens=False)``, and back."""

    def __init__(self, vocabulary: str, classes: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        model = spec["model"]
        super().__init__(classes, {t["content"]: t["id"] for t in spec["added_tokens"]})
        self.normalizer = Tokenizer.from_str(vocabulary).normalizer
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        ids: dict[str, int] = model["vocab"]
        self.inner = np.array([ids[c] for c in letters])
        self.final = np.array([ids[c + suffix] for c in letters])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        #: Which bytes stand side by side inside a token; the second table is for a word's last byte.
        self.within = np.zeros((2, 256, 256), dtype=bool)
        for token in ids:
            ended = token.endswith(suffix) and len(token) > len(suffix)
            value = [byte_of[c] for c in (token[: -len(suffix)] if ended else token)]
            for k in range(1, len(value)):
                self.within[int(ended and k == len(value) - 1), value[k - 1], value[k]] = True
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def prepared(self, text: str) -> str:
        """Composed and in lower case; blanks are dropped later, however many."""
        if not text or max(text) < SURE:
            return unicodedata.normalize("NFC", text).lower()
        return self.normalizer.normalize_str(text)

    def cut(self, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = layout.data
        chars = np.flatnonzero(lone_pieces(layout))
        bounds = layout.at[chars]
        start = np.zeros(len(data) + 1, dtype=bool)
        start[bounds] = True
        last = np.zeros(len(data), dtype=np.int8)
        last[bounds[1:] - 1] = 1
        start[1:-1] |= ~self.within[last[1:], data[:-1], data[1:]]
        edges = np.flatnonzero(start)
        starts, ends = edges[:-1], edges[1:]
        blank = np.zeros(len(data), dtype=bool)
        blank[layout.at[:-1][layout.kinds == SPACE]] = True
        words = ~blank[starts]
        # Blanks of several bytes may have been cut inside; their rest is no word either.
        inside = (data[starts] & 0xC0) == 0x80
        if inside.any():
            of = np.searchsorted(layout.at, starts, side="right") - 1
            words &= layout.kinds[of] != SPACE
        starts, ends = starts[words], ends[words]
        return starts, ends, last[ends - 1].astype(np.int64)

    def encode_new(self, data, starts, ends, marks) -> list:
        whole = data.tobytes()
        return [self.fragment(whole[a:b], bool(m)) for a, b, m in zip(starts, ends, marks)]

    def fragment(self, value: bytes, ends_word: bool) -> list[int]:
        """Ids of one fragment: the earliest learned merge first, the leftmost of equal ones."""
        ids = self.inner[np.frombuffer(value, dtype=np.uint8)].tolist()
        if ends_word:
            ids[-1] = int(self.final[value[-1]])
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        merges = self.merges
        heap = [(*merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in merges:
                    heapq.heappush(heap, (*merges[p], a, *p))
        return [i for i in ids if i >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text as the library's ``decode(ids, skip_special_tokens=False)``, in UTF-8.

        The vocabulary names no decoder, so tokens are joined by spaces as they are written.
        """
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


OUTPUT = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_and_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Null and empty texts have no ids and decode to the empty text; repeated rows and null
    ids are rows like any other; an empty table gives an empty result. Other columns are
    not looked at. Nothing is shuffled. A long text is worked on in slices that end where
    a word does, and a worker keeps a bounded number of fragments it has met.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(f"word-bpe-{vocabulary_path}", lambda: WordBpe(*sent.value), alone=True)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                found = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(ids) for ids in found], pa.int64()),
                        pa.array([ids.astype("<u4").tobytes() for ids in found], pa.binary()),
                        pa.array([coder.decode(ids) for ids in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return texts(docs).mapInArrow(run, OUTPUT)
