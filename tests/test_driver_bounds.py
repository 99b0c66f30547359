"""What passes the driver stays bounded while tables grow."""

import re
from datetime import datetime, timedelta

from faultline import session
from faultline.catalog import reports
from faultline.catalog import workspace as ws
from faultline.operators import positions, search
from faultline.plans import investigate, runbooks
from tests.test_plans import plan


def test_tables_of_texts_never_pass_the_driver(spark, sf, monkeypatch):
    made = {}
    monkeypatch.setattr(ws, "materialize", lambda df, label, write=ws.materialize: made.setdefault(label, plan(df)) and write(df, label))
    ws.forget()
    ws.steps(spark, sf)
    for name in ("prompts", "checked"):
        assert "BroadcastExchange" not in made[name] and "SortMergeJoin" in made[name]
    assert plan(ws.detail(spark, sf)).count("BroadcastExchange") <= 1  # the names of services, which are counted


def test_slices_of_spans_are_broadcast_only_when_counted_small(spark, tmp_path, monkeypatch):
    """A few bytes of file hold spans of many slices each, which Spark does not see."""
    start = datetime(2024, 1, 1)
    facts = [(i, i % 3, start + timedelta(hours=i)) for i in range(200)] + [(200, None, start)]
    spans = [(i, i % 3, start + timedelta(hours=i), start + timedelta(hours=i + 30)) for i in (0, 0, 4, 100)]
    spans += [(9, None, start, start + timedelta(hours=30))]
    spark.createDataFrame(facts, "id long, service_id long, timestamp timestamp_ntz").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame(spans, "span_id long, service_id long, opens timestamp_ntz, closes timestamp_ntz").write.parquet(
        f"{tmp_path}/s"
    )
    facts, spans = spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/s")

    small = positions._near_spans(facts, spans, "service_id", "timestamp")
    assert "BroadcastExchange" in plan(small)
    monkeypatch.setattr(positions, "fits_broadcast", lambda df: False)
    large = positions._near_spans(facts, spans, "service_id", "timestamp")
    assert "BroadcastExchange" not in plan(large) and "SortMergeJoin" in plan(large)
    kept = sorted(r["id"] for r in large.collect())
    assert kept == sorted(r["id"] for r in small.collect())
    # Every fact inside a span is kept, and none that is an hour or more away from all of them.
    assert set(range(0, 31, 3)) | set(range(4, 35, 3)) | set(range(100, 131, 3)) <= set(kept) and len(kept) < 40


def test_a_report_broadcasts_only_what_was_counted(spark, sf, monkeypatch):
    """With nothing counted as small, only the starts of partitions are broadcast, one row for each partition."""
    made = []
    for step in ("materialize", "checkpoint"):
        write = getattr(session, step)
        for module in (session, positions, search, investigate, runbooks, ws):
            if hasattr(module, step):
                monkeypatch.setattr(module, step, lambda df, *label, write=write: made.append(plan(df)) or write(df, *label))
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    ws.forget()
    try:
        made.append(plan(reports.investigation_report(spark, sf)))
    finally:
        ws.forget()
    joins = re.findall(r"BroadcastHashJoin (\[.*?\], \[.*?\])", "\n".join(made))
    assert len(made) > 10 and joins  # those of the starts
    assert [keys for keys in joins if not re.fullmatch(r"\[_part#\d+L\], \[_part#\d+L\]", keys)] == []
