"""Byte-level BPE ids of whole texts, with the tokenizers library for pieces not met before."""

from __future__ import annotations

import os

import numpy as np

from faultline.llm.pieces import ArrayEncoder, Layout, spaced_pieces

# Pieces in one call of the library.
LINES = 2000


class ByteEncoder(ArrayEncoder):
    """Ids as by the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, vocabulary: str, classes: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__(classes, {t.content: i for i, t in self.library.get_added_tokens_decoder().items()})
        (self.line_end,) = self._alone("\n")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def _alone(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def cut(self, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = layout.at[np.flatnonzero(spaced_pieces(layout))]
        return start[:-1], start[1:], np.zeros(len(start) - 1, dtype=np.int64)

    def encode_new(self, data, starts, ends, marks) -> list:
        """One call per line of many pieces: calls are dear, and a line end parts pieces."""
        whole = data.tobytes()
        pieces = [whole[a:b].decode("utf-8") for a, b in zip(starts, ends)]
        found: list = [self._alone(p) if p.isspace() else None for p in pieces]
        plain = [i for i, ids in enumerate(found) if ids is None]
        for k in range(0, len(plain), LINES):
            some = plain[k : k + LINES]
            text = "".join(pieces[i] + "\n" for i in some)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            bounds = np.flatnonzero(ids == self.line_end)
            for i, line in zip(some, np.split(ids, bounds + 1)[: len(some)], strict=True):
                found[i] = line[:-1].tolist()
        return found
