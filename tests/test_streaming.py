"""Streams give what the batch operators give."""

import json

from pyspark.sql import functions as F

from lumentrace.functions import json_repair
from lumentrace.operators import filters
from lumentrace.streaming import streams


def test_properties_equal_batch(spark, tmp_path):
    rows = [{"row_idx": i, "raw_response": json.dumps([{"property_description": f"d{i}", "behavior_type": "Style"}]) if i % 3 else "broken"} for i in range(9)]
    for part in range(3):
        path = tmp_path / "in" / f"{part}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(map(json.dumps, rows[part * 3 : part * 3 + 3])))
    schema = "row_idx long, raw_response string"
    source = streams.json_source(spark, f"file://{tmp_path}/in", schema, 1)
    streams.start(streams.properties(source), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    got = {(r.row_idx, r.property_description) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = json_repair.parsed_rows(spark.createDataFrame(rows, schema)).where("error_type is null").where(filters.valid_property())
    assert got == {(r.row_idx, r.property_description) for r in batch.collect()} and len(got) == 6


def test_merged_batches_and_sessions(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"id": 1, "at": "2024-01-01T00:00:00Z", "u": "x"}\n{"id": 1, "at": "2024-01-01T00:00:00Z", "u": "x"}\n{"id": 2, "at": "2024-01-01T05:00:00Z", "u": "x"}')
    source = streams.json_source(spark, f"file://{path}", "id long, at timestamp, u string")
    streams.merged(source, f"file://{tmp_path}/m", f"file://{tmp_path}/ck", ["id"]).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == 2
    (path / "b.json").write_text('{"id": 2, "at": "2024-01-01T05:00:00Z", "u": "y"}\n{"id": 3, "at": "2024-01-01T06:00:00Z", "u": "y"}')
    streams.merged(source, f"file://{tmp_path}/m", f"file://{tmp_path}/ck", ["id"]).awaitTermination()
    assert sorted((r.id, r.u) for r in spark.read.parquet(f"file://{tmp_path}/m").collect()) == [(1, "x"), (2, "x"), (3, "y")]
    batch = spark.read.schema("id long, at timestamp, u string").json(f"file://{path}/a.json")
    assert sorted(r.n for r in streams.sessions(batch, "at", "u").collect()) == [1, 2]
    assert streams.windowed_counts(batch, "at", "u").agg(F.sum("n")).first()[0] == 3


def test_keys_live_for_a_while(spark, tmp_path):
    """A key comes again once its time to live has passed; rows later than that are dropped; the target is not read."""
    path = tmp_path / "in"
    path.mkdir()
    schema = "id long, at timestamp"
    run = lambda: streams.merged(streams.json_source(spark, f"file://{path}", schema, 1), f"file://{tmp_path}/m", f"file://{tmp_path}/ck", ["id"], ts="at", ttl="1 hour")
    for name, rows in {"a": [(1, "00:00"), (1, "00:10"), (2, "00:20")], "b": [(1, "00:30"), (3, "09:00")], "c": [(1, "09:10"), (4, "00:40")]}.items():
        (path / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "at": f"2024-01-01T{t}:00Z"}) for i, t in rows))
        query = run()
        query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/m").collect()) == [1, 1, 2, 3]


def test_streams_are_paired_in_time(spark, tmp_path):
    for name, rows in {"left": [(1, "00:00"), (2, "01:00")], "right": [(1, "00:30"), (1, "02:00"), (2, "00:59"), (3, "01:00")]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(json.dumps({"u": u, f"{name}_at": f"2024-01-01T{t}:00Z"}) for u, t in rows))
    left, right = (streams.json_source(spark, f"file://{tmp_path}/{n}", f"u long, {n}_at timestamp") for n in ("left", "right"))
    streams.start_with_state(streams.paired(left, right, "u", "left_at", "right_at"), f"file://{tmp_path}/p", f"file://{tmp_path}/ck").awaitTermination()
    assert [(r.u, r.right_at.minute) for r in spark.read.parquet(f"file://{tmp_path}/p").collect()] == [(1, 30)]
