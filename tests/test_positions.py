"""Spans by position against brute force, with one service holding a third of all rows."""

import random
from datetime import datetime, timedelta

import pytest

from faultline.operators import positions as P
from tests.conftest import rows

START = datetime(2024, 1, 1)
FACTS = "id long, service_id long, timestamp timestamp_ntz, metric string, value double"
SPANS = "span_id long, service_id long, opens timestamp_ntz, closes timestamp_ntz"


def make(seed, facts=900, spans=120, seconds=400):
    rng = random.Random(seed)

    def moment():
        return START + timedelta(seconds=rng.randrange(seconds))

    def service():
        return 7 if rng.random() < 0.34 else rng.randrange(12)

    fact_rows = [
        (i, service(), moment(), rng.choice("ab"), float(rng.randrange(1000))) for i in range(facts)
    ]
    span_rows = []
    for i in range(spans):
        opens = moment()
        closes = opens + timedelta(seconds=rng.choice((0, 1, 20, 200)))
        span_rows.append((i, rng.choice((7, service(), 99)), rng.choice((opens, opens, None)), closes))
    return fact_rows, span_rows


def inside(span, facts):
    _, service, opens, closes = span
    found = [f for f in facts if f[1] == service and (opens is None or f[2] >= opens) and f[2] <= closes]
    return sorted(found, key=lambda f: (f[2], f[0]))


def located(spark, facts, spans):
    return P.locate_spans(
        spark.createDataFrame(facts, FACTS).repartition(5),
        spark.createDataFrame(spans, SPANS).repartition(3),
        key="service_id", time="timestamp", tie="id",
    )


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    facts, spans = make(request.param)
    numbered, where = located(spark, facts, spans)
    return facts, spans, numbered, where


def test_positions_are_the_global_order(case):
    facts, _, numbered, _ = case
    order = {r["id"]: r["position"] for r in numbered.collect()}
    kept = sorted((f for f in facts if f[0] in order), key=lambda f: (f[1], f[2], f[0]))
    assert [order[f[0]] for f in kept] == list(range(len(kept)))


@pytest.mark.parametrize("n", [1, 5, 80])
def test_first_and_last(case, n):
    facts, spans, numbered, where = case
    first = {(r["span_id"], r["rank"]): r["id"] for r in P.first_in_span(numbered, where, n).collect()}
    last = {(r["span_id"], r["rank"]): r["id"] for r in P.last_in_span(numbered, where, n).collect()}
    want_first, want_last = {}, {}
    for span in spans:
        found = inside(span, facts)
        want_first.update({(span[0], k + 1): f[0] for k, f in enumerate(found[:n])})
        want_last.update({(span[0], k + 1): f[0] for k, f in enumerate(found[::-1][:n])})
    assert first == want_first
    assert last == want_last


@pytest.mark.parametrize("branch", [2, 3, 32])
def test_summaries_at_every_block_size(case, branch, monkeypatch):
    facts, spans, numbered, where = case
    monkeypatch.setattr(P, "BRANCH", branch)
    got = {
        (r["span_id"], r["metric"]): (r["min"], r["max"], round(r["avg"], 6), r["samples"])
        for r in P.summarize_spans(numbered, where, ["metric"], "value").collect()
    }
    want = {}
    for span in spans:
        for metric in "ab":
            values = [f[4] for f in inside(span, facts) if f[3] == metric]
            if values:
                want[span[0], metric] = (
                    min(values), max(values), round(sum(values) / len(values), 6), len(values)
                )
    assert got == want


def test_shuffled_form_when_services_do_not_fit_a_broadcast(spark, monkeypatch):
    facts, spans = make(3, facts=200, spans=30)
    small = rows(P.first_in_span(*located(spark, facts, spans), 5).orderBy("span_id", "rank"))
    monkeypatch.setattr(P, "fits_broadcast", lambda df: False)
    large = rows(P.first_in_span(*located(spark, facts, spans), 5).orderBy("span_id", "rank"))
    assert small == large


def test_no_facts_and_no_spans(spark):
    numbered, where = located(spark, [], make(4)[1])
    assert P.first_in_span(numbered, where, 5).count() == 0
    assert P.summarize_spans(numbered, where, ["metric"], "value").count() == 0
    numbered, where = located(spark, make(4)[0], [])
    assert P.last_in_span(numbered, where, 5).count() == 0


def test_all_facts_at_one_moment_of_one_service(spark):
    facts = [(i, 1, START, "a", 1.0) for i in range(500)]
    spans = [(i, 1, START, START) for i in range(40)]
    numbered, where = located(spark, facts, spans)
    got = P.summarize_spans(numbered, where, ["metric"], "value").collect()
    assert {(r["span_id"], r["samples"]) for r in got} == {(i, 500) for i in range(40)}
    first = P.first_in_span(numbered, where, 3).filter("span_id = 17").orderBy("rank").collect()
    assert [r["id"] for r in first] == [0, 1, 2]


def test_only_facts_near_a_span_are_ordered(spark):
    facts = [(i, i % 3, START + timedelta(hours=i // 3), "a", 1.0) for i in range(3000)]
    spans = [(k, 1, START + timedelta(hours=h, minutes=-20), START + timedelta(hours=h, minutes=20)) for k, h in enumerate((50, 51, 900))]
    numbered, where = located(spark, facts, spans)
    assert numbered.count() <= 8
    got = {(r["span_id"], r["id"]) for r in P.first_in_span(numbered, where, 5).collect()}
    assert got == {(0, 151), (1, 154), (2, 2701)}
    none, _ = located(spark, facts, [])
    assert none.count() == 0
