import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from faultline.llm import bpe, pieces, queries, records
from faultline.llm.tokens import ByteEncoder
from llm_tables import ODD, listed, none, odd

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def strange_texts():
    rng = random.Random(7)
    letters = "ab 's\n\té Σ 1٣!<|>日́lvred\x85\xa0\x1c"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return [*some, " 's 'sx ''s !!'s's 'll'LL 're", "İSTANBUL ΣΑΣ ñ é ǅ", "½ ² ५", "a" * 5000, "x<|startoftext|><|endoftext|>y"]


@pytest.mark.parametrize("path, kind", [(WORD, bpe.WordBpe), (BYTE, ByteEncoder)])
def test_ids_are_those_of_the_library(path, kind):
    with open(path, encoding="utf-8") as file:
        mine = kind(file.read(), pieces.character_classes())
    library = Tokenizer.from_file(path)
    for text, ids in zip(strange_texts(), mine.encode(strange_texts())):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted, text
        if kind is bpe.WordBpe:
            assert mine.decode(ids).decode() == library.decode(wanted, skip_special_tokens=False)


def test_a_cut_is_never_inside_a_token():
    with open(WORD, encoding="utf-8") as file:
        mine = bpe.WordBpe(file.read(), pieces.character_classes())
    letters = bpe.byte_letters()
    cuts = 0
    for a in range(97, 123):
        for b in range(97, 123):
            if not mine.within[0, a, b]:
                cuts += 1
                pair = letters[a] + letters[b]
                assert not any(pair in name.decode().removesuffix("</w>")[:-1] for name in mine.names[:5000])
    assert cuts


def test_long_texts_are_sliced_between_words():
    text = "ab cd. " * 1000
    parts = pieces.slices(text, 100)
    assert "".join(parts) == text and len(parts) > 50
    assert all(p[0] == " " and p[1] != " " for p in parts[1:])
    assert pieces.slices("x" * 1000, 100) == ["x" * 1000]


def test_round_trip_of_odd_rows(spark):
    library = Tokenizer.from_file(WORD)
    found = listed(bpe.encode_and_decode(odd(spark), WORD))
    wanted = []
    for row in ODD:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        wanted.append((row[0], len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in found), key=key) == sorted(wanted, key=key)
    assert listed(bpe.encode_and_decode(none(spark), WORD)) == []


def test_round_trip_query(spark, sf):
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = listed(queries.op1_bpe_round_trip(spark, sf))
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283
    rng = random.Random(5)
    parts = [rng.randbytes(n) for n in (4, 5, 8, 255, 256, 257, 900, 3000, 256, 4)]
    masked = [(((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF for c in map(crc32c, parts)]
    assert records.masked_checksums(parts).tolist() == masked


def test_damaged_records_are_refused():
    whole = b"".join(records.frames([b"first record", b"second one"]))
    assert records.payloads_of(whole) == [b"first record", b"second one"]
    for at in (0, 9, 14, len(whole) - 1):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.payloads_of(bytes(broken))
    with pytest.raises(ValueError):
        records.payloads_of(whole[:-3])


def check_records(found, rows, library):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode()), r[1] or ""))
    found = sorted(found, key=lambda r: r["start"])
    start = 0
    for row, (doc_id, text) in zip(found, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids))
        assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        start += len(ids)


def test_records_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 1000)
    folder = str(tmp_path / "records")
    manifest = records.write_records(odd(spark), BYTE, folder).cache()
    assert manifest.count() > 1
    library = Tokenizer.from_file(BYTE)
    check_records(listed(records.read_records(manifest, folder)), [(r[0], r[1]) for r in ODD], library)
    first = manifest.orderBy("part", "turn").first()
    files, base = fs.FileSystem.from_uri(folder)
    one = records.read_some(files, f"{base}/{first['name']}", [first["rows"] - 1, 0])
    assert [struct.unpack_from("<q", p)[0] for p in one][1] == 1
    empty = records.write_records(none(spark), BYTE, str(tmp_path / "none")).cache()
    assert listed(empty) == [] and listed(records.read_records(empty, str(tmp_path / "none"))) == []


def test_records_query(spark, sf):
    library = Tokenizer.from_file(BYTE)
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found, start = sorted(listed(queries.op4_binary_records(spark, sf)), key=lambda r: r["start"]), 0
    for row, (doc_id, text) in zip(found, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        data = np.array(ids, dtype="<u4").tobytes()
        assert row == {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(data)}
        start += len(ids)
