import hashlib
import re

import numpy as np
import pytest

from faultline.llm import personal, queries
from llm_tables import ODD, listed, none, odd

# The contract's patterns as they are written there.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(sum(map(int, str(d))) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def contract(text):
    return [
        (k, *m.span()) for k, p in CONTRACT.items() for m in re.finditer(p, text) if passes(k, m[0])
    ]


TEXTS = [
    "a@b.c@d.e x@y a.b+c%@d-e.f.g. @q.r a@@b.c a@b..c a@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.3.4 1.2.3.4@x.yz 0.0.0.0255",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 1- 2 4111  1111 1111 1111",
    "+1 (555) 123-4567 +12345678 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++49 30 12345678) +4-",
    "é+44 20 7946 0958🙂 ü.x@mail.de 10.0.0.1\n10.0.0.2",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_of_odd_texts(text):
    named = [(personal.KINDS[k], s, e) for k, s, e in personal.base_spans(text)]
    assert named == contract(text)


def test_base_spans_at_random():
    rng = np.random.default_rng(3)
    for alphabet in ("a@.-_b ", "12.5 0@", "41-2 90", "+1 (2).3-", "a1@+.- "):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), 60))
            named = [(personal.KINDS[k], s, e) for k, s, e in personal.base_spans(text)]
            assert named == contract(text), text


def test_query_has_all_base_spans_of_the_given_table(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    query = queries.op12_personal(spark, sf)
    assert query.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = listed(query)
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = contract(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in CONTRACT] == [sum(b[0] == k for b in base) for k in CONTRACT]
        spans = [] if not r["spans"] else [tuple(s.split(":")) for s in r["spans"].split(",")]
        order = [(personal.KINDS.index(k), int(s)) for k, s, _ in spans]
        assert order == sorted(order) and {f"{k}:{s}:{e}" for k, s, e in base} <= {":".join(s) for s in spans}


def test_votes_are_weighed_by_how_they_meet():
    rng = np.random.default_rng(5)
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.52])
    truth = rng.random(20_000) < 0.3
    said = np.where(rng.random((20_000, 6)) < right, truth[:, None], ~truth[:, None])
    silent = rng.random((20_000, 6)) < 0.2
    votes = np.where(silent, 0, np.where(said, 1, 2))
    codes, counts = np.unique(votes @ 3 ** np.arange(6), return_counts=True)
    share, table, likely = personal.reliabilities(codes, counts.astype(float))
    assert abs(share - truth.mean()) < 0.02
    found = table[1, :, 1] / (table[1, :, 1] + table[1, :, 2])
    assert np.abs(found - right).max() < 0.04
    named = dict(zip(codes.tolist(), likely))
    guess = np.array([named[c] for c in (votes @ 3 ** np.arange(6)).tolist()]) >= 0.5
    assert (guess == truth).mean() > (((votes == 1).sum(1) > (votes == 2).sum(1)) == truth).mean()
    assert (guess == truth).mean() > 0.96


PLANTED = {
    "email": ["{w}.{a} [at] mail (dot) example (dot) org", "{w}{a}@(at)", "{w}.{a} (at) mail.example.com"],
    "phone": ["call ({a:03d}) 555-{b:04d}", "phone {a:03d}-555-{b:04d}", "tel {a:03d} 555 {b:04d}"],
    "ip": ["host 2001:db8:{a:x}:{b:x}:1:2:3:4"],
}


def test_spans_beyond_the_patterns(spark, sf):
    """Spelled addresses, numbers without a plus and long ips in real texts, and clean numbers beside them."""
    words = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows, wanted, clean = [], {}, set()
    for i, text in enumerate(t for t in words if t and len(t) > 200):
        at = text.find(" ", 100)
        kinds = [("email", 0), ("email", 2), ("phone", 0), ("phone", 1), ("phone", 2), ("ip", 0)]
        if i % 3 == 0:
            kind, form = kinds[i // 3 % 6]
            said = PLANTED[kind][form].format(w="anna", a=200 + i % 700, b=1000 + 7 * i % 9000)
            begin = at + 1 + (said.index(" ") + 1 if kind != "email" else 0)
            wanted[i] = (kind, begin, at + 1 + len(said))
        elif i % 3 == 1:
            said = ["order {}", "version {}", "key_{}x", "invoice {}"][i % 4].format(10**7 * (i + 1) + 12345)
            clean.add(i)
        else:
            continue
        rows.append((i, f"{text[:at]} {said} {text[at + 1 :]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in listed(personal.scan(docs))}
    hit = sum(any(s["kind"] == k and s["start"] <= a + 1 and s["end"] >= b for s in found[i]) for i, (k, a, b) in wanted.items())
    assert len(wanted) > 30 and hit >= 0.9 * len(wanted)
    extra = [s for i in clean for s in found[i] if not s["base"]]
    assert len(extra) <= 0.02 * len(clean)


def test_scan_equals_the_model_row_by_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = personal.learn(personal.extracted(docs).cache())
    for r in listed(personal.scan(docs).join(docs.select("doc_id", "text"), "doc_id")):
        base = personal.base_spans(r["text"] or "")
        want = [(k, s, e, True) for k, s, e in base]
        for kind, start, end, code, cells in personal.candidates(r["text"] or "", base):
            if (kind, start, end) not in base and code % 3 != 2 and model.likely[kind][code] >= 0.5:
                if 1 / (1 + np.exp(-model.weights[cells].sum())) >= personal.ACCEPT:
                    want.append((kind, start, end, False))
        assert [(personal.KINDS.index(s["kind"]), s["start"], s["end"], s["base"]) for s in r["spans"]] == sorted(want)


def test_odd_rows(spark):
    rows = ODD + [(9, "mail a@b.com or +1 (555) 123-4567", "en", None, None, "a", "b")] * 2
    rows += [(10, "1" * 60_000 + "@" * 50_000 + "a." * 30_000 + "@" + "+1" + " (" * 20_000, None, None, None, None, None)]
    found = listed(personal.scan(odd(spark, rows)))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert [len(r["spans"]) for r in found if r["doc_id"] == 9] == [2, 2]
    assert all(not r["spans"] for r in found if r["doc_id"] != 9)
    digest = listed(personal.digests(personal.scan(odd(spark, [ODD[2]]))))
    assert digest[0]["spans"] == "" and digest[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert listed(personal.scan(none(spark))) == []
