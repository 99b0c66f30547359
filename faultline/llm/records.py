"""Token ids as length-delimited binary records, with a separate offset index.

A record is: length (unsigned 64 bits), masked CRC-32C of these 8 bytes, the payload,
masked CRC-32C of the payload; little-endian throughout. The payload of a document is its
id (64 bits), a flag (1: has an id), the number of ids, the bytes of an id (32 bits each),
then the ids: of 2 bytes where the vocabulary allows it, else 4. Beside ``x.records`` lies ``x.index``: the
first byte of each record and the file's size, as unsigned 64-bit integers.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import texts, worker_state
from faultline.llm.pieces import character_classes
from faultline.llm.tokens import ByteEncoder

# Documents that are encoded, written or read at once, and the size at which a file ends.
BATCH, FILE_BYTES = 500, 64 << 20
HEAD, FRAME = "<qIII", "<QI"
# Reversed Castagnoli polynomial, and what is added in masking: fixed values of the format.
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8
FRAME_BYTES, LANE = 12, 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of four bytes at a time, and of 32 bits moved on by a lane of zeros."""
    line = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        line = np.where(line & 1, (line >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), line >> np.uint32(1))
    steps = [line]
    for _ in range(3):
        steps.append(line[steps[-1] & 255] ^ (steps[-1] >> np.uint32(8)))
    by_word = np.array(steps, dtype=np.uint32)
    by_lane = []
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(LANE // 4):
            state = _word(by_word, state)
        by_lane.append(state)
    return by_word, np.array(by_lane, dtype=np.uint32)


def _word(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    low, high = tables[3][state & 255], tables[2][(state >> np.uint32(8)) & 255]
    return low ^ high ^ tables[1][(state >> np.uint32(16)) & 255] ^ tables[0][state >> np.uint32(24)]


def _lane_on(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    low, high = tables[0][state & 255], tables[1][(state >> np.uint32(8)) & 255]
    return low ^ high ^ tables[2][(state >> np.uint32(16)) & 255] ^ tables[3][state >> np.uint32(24)]


def masked_checksums(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each part (4 bytes or more), all of them side by side.

    Parts are padded on the left into lanes, which start from zero and so can be worked on
    together; a part's lanes are then put one after another.
    """
    by_word, by_lane = worker_state("crc-32c", _tables)
    lengths = np.array([len(p) for p in parts])
    lanes = -(-lengths // LANE)
    ends = np.cumsum(lanes)
    zeros = bytes(LANE)
    data = bytearray().join(x for p in parts for x in (zeros[: -len(p) % LANE], p))
    flat = np.frombuffer(data, dtype=np.uint8)
    flat[((ends * LANE - lengths)[:, None] + np.arange(4)).ravel()] ^= 255
    state = np.zeros(int(ends[-1]), dtype=np.uint32)
    for words in np.ascontiguousarray(flat.view("<u4").reshape(-1, LANE // 4).T):
        state = _word(by_word, state ^ words)
    order = np.argsort(-lanes, kind="stable")
    most, first = lanes[order], (ends - lanes)[order]
    total = np.zeros(len(parts), dtype=np.uint32)
    for step in range(int(most[0])):  # the last lanes of all parts come together
        at = step - (most[0] - most)
        now = int(np.searchsorted(-at, 0, side="right"))
        total[:now] = _lane_on(by_lane, total[:now]) ^ state[first[:now] + at[:now]]
    found = np.empty_like(total)
    found[order] = total ^ np.uint32(0xFFFFFFFF)
    return ((found >> np.uint32(15)) | (found << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """The records of payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    pairs = zip(heads, masked_checksums(heads).tolist(), payloads, masked_checksums(payloads).tolist())
    return [b"".join((h, a.to_bytes(4, "little"), p, b.to_bytes(4, "little"))) for h, a, p, b in pairs]


def payloads_of(data: bytes) -> list[bytes]:
    """The payloads of whole records; raises where a length or a checksum is wrong."""
    heads, found, sums, at = [], [], [], 0
    while at < len(data):
        size, head_sum = struct.unpack_from(FRAME, data, at)
        end = at + FRAME_BYTES + size
        if end + 4 > len(data):
            raise ValueError("a record is cut off")
        heads.append(data[at : at + 8])
        found.append(data[at + FRAME_BYTES : end])
        sums += [head_sum, int.from_bytes(data[end : end + 4], "little")]
        at = end + 4
    if found:
        right = np.stack([masked_checksums(heads), masked_checksums(found)], axis=1)
        if (right.ravel() != np.array(sums, dtype=np.uint32)).any():
            raise ValueError("a checksum is wrong")
    return found


def read_some(files, name: str, places: list[int]) -> list[bytes]:
    """Payloads of the records at these places, through the index: a shuffled read."""
    with files.open_input_file(f"{name}.index") as index, files.open_input_file(f"{name}.records") as records:
        found = []
        for k in places:
            a, b = np.frombuffer(index.read_at(16, 8 * k), dtype="<u8").tolist()
            found += payloads_of(records.read_at(b - a, a))
        return found


class Writer:
    """Writes records into files of about ``FILE_BYTES``, each beside its index."""

    def __init__(self, folder: str, part: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.part, self.turn, self.out = part, 0, None

    def write(self, payloads: list[bytes], tokens: int) -> Iterator[tuple]:
        if self.out is None:
            # A task that runs again writes other files; those named in the manifest count.
            self.name = f"part-{self.part:06d}-{self.turn:04d}-{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}.records")
            self.offsets, self.rows, self.tokens = [0], 0, 0
        for record in frames(payloads):
            self.out.write(record)
            self.offsets.append(self.offsets[-1] + len(record))
        self.rows, self.tokens = self.rows + len(payloads), self.tokens + tokens
        if self.offsets[-1] >= FILE_BYTES:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        with self.files.open_output_stream(f"{self.folder}/{self.name}.index") as index:
            index.write(np.array(self.offsets, dtype="<u8").tobytes())
        row = (self.part, self.turn, self.name, self.rows, self.tokens)
        self.out, self.turn = None, self.turn + 1
        return row


MANIFEST = "part int, turn int, name string, rows long, tokens long"


def write_records(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the ids of every text, and ``end_id`` after each, in ascending doc_id order.

    Returns the manifest, one row per file; it has to be stored before it is read twice,
    as reading it writes the files. Null and empty texts have the end id alone, null ids
    come last, repeated rows stand side by side, an empty table writes no file. ``folder``
    must be one that all executors share, of a kind that Arrow opens (file, hdfs, s3, gs).

    Texts are dealt by ranges of (doc_id, length), so rows that share one id spread as well.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(f"byte-bpe-{vocabulary_path}", lambda: ByteEncoder(*sent.value), alone=True)
        writer = Writer(folder, TaskContext.get().partitionId())
        end = np.array([end_id], dtype=coder.kind).tobytes()
        closed = []
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                ids = coder.encode(part.column(1).to_pylist())
                heads = [
                    struct.pack(HEAD, i or 0, i is not None, len(x) + 1, coder.kind.itemsize)
                    for i, x in zip(part.column(0).to_pylist(), ids)
                ]
                payloads = [h + x.astype(coder.kind).tobytes() + end for h, x in zip(heads, ids)]
                closed += writer.write(payloads, sum(map(len, ids)) + len(ids))
        if writer.out is not None:
            closed.append(writer.close())
        names = ["part", "turn", "name", "rows", "tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in closed], kinds[i]) for i in range(5)], names=names)

    order = [F.col("doc_id").asc_nulls_last(), F.octet_length("text")]
    dealt = texts(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return dealt.mapInArrow(run, MANIFEST)


RECORDS = "doc_id long, start long, n_tokens long, ids binary"


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian).

    ``start`` counts the ids of all documents before. Lengths and checksums are checked; a
    damaged file fails the query. One task streams a file.
    """
    before = Window.orderBy("part", "turn")  # over files, not rows
    files = manifest.select("part", "name", (F.sum("tokens").over(before) - F.col("tokens")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with system.open_input_file(f"{base}/{name}.index") as index:
                    offsets = np.frombuffer(index.read(), dtype="<u8").tolist()
                with system.open_input_stream(f"{base}/{name}.records") as records:
                    for k in range(0, len(offsets) - 1, BATCH):
                        last = min(k + BATCH, len(offsets) - 1)
                        rows = []
                        for payload in payloads_of(records.read(offsets[last] - offsets[k])):
                            doc_id, has_id, count, width = struct.unpack_from(HEAD, payload)
                            ids = np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(HEAD))
                            if len(ids) != count:
                                raise ValueError("a record has another number of ids than it says")
                            rows.append((doc_id if has_id else None, start, count, ids.astype("<u4").tobytes()))
                            start += count
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[i] for r in rows], kinds[i]) for i in range(4)],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return files.repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)
