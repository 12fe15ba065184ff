"""Snapshots and policies: there, absent, broken and of another version."""

import json

import pytest
from pyspark.sql import functions as F

from ripplegraph.sources import files

DOCUMENT = {
    "schema_version": 2,
    "provenance": {"generated_at": "2024-01-01"},
    "relations": {"d.s.t": {"database": "d", "schema": "s", "table": "t"}},
    "cards": [{"card_id": 1, "name": "é", "columns": [{"relation": "d.s.t", "column": "c", "role": "filter", "confidence": "high"}], "upstream_card_ids": [2], "extra": 1}, {"card_id": 2}],
    "dashboards": [{"dashboard_id": 7, "card_ids": [1, 2], "meta": {"tier": 1}}],
}


def test_a_document_and_what_it_becomes_when_written(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(DOCUMENT))
    got = files.load_snapshot(spark, f"file://{tmp_path}/s.json")
    path = f"file://{tmp_path}/out"
    files.dump_snapshot(got, path, {"by": "test"})
    again = files.load_snapshot(spark, path)
    for s in (got, again):
        cards = {r.card_id: r for r in s["cards"].collect()}
        assert cards[1].name == "é" and cards[1].columns[0].role == "filter" and cards[1].upstream_card_ids == [2] and cards[2].updated_at is None
        assert s["dashboards"].select(F.try_variant_get("meta", "$.tier", "int")).first()[0] == 1
        assert tuple(s["relations"].first()) == ("d.s.t", "d", "s", "t")
    assert got["provenance"].select(F.to_json("provenance")).first()[0] == '{"generated_at":"2024-01-01"}'
    assert again["provenance"].select(F.to_json("provenance")).first()[0] == '{"by":"test"}'


def test_the_last_head_counts_and_a_writer_that_fails_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    tables = lambda n: {"cards": spark.range(n).selectExpr("id as card_id"), "dashboards": spark.range(1).selectExpr("id as dashboard_id"), "relations": spark.range(0).selectExpr("'x' as relation")}
    files.dump_snapshot(tables(3), path)
    broken = tables(5) | {"dashboards": spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("dashboard_id"))}
    with pytest.raises(Exception, match="stop"):
        files.dump_snapshot(broken, path)
    assert files.load_snapshot(spark, path)["cards"].count() == 3
    folder = files.dump_snapshot(tables(4), path)
    assert files.load_snapshot(spark, path)["cards"].count() == 4
    for f in (tmp_path / "snap" / folder / "cards").glob("part-*"):
        f.write_text('{"card_id": 1}\n')
    for f in (tmp_path / "snap" / folder / "cards").glob(".*.crc"):
        f.unlink()
    with pytest.raises(files.SnapshotError, match="rows"):
        files.load_snapshot(spark, path)


def test_absent_broken_and_unknown(spark, tmp_path):
    assert files.load_snapshot(spark, None) is None and files.load_snapshot(spark, f"file://{tmp_path}/no.json") is None
    cases = {"text": "not json", "list": "[]", "version": json.dumps(DOCUMENT | {"schema_version": 3}), "none": "{}", "word": json.dumps(DOCUMENT | {"schema_version": "2"}), "flag": json.dumps(DOCUMENT | {"schema_version": True}), "shape": json.dumps(DOCUMENT | {"cards": {"card_id": 1}}), "id": json.dumps(DOCUMENT | {"cards": [{"card_id": "x"}]})}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(files.SnapshotError):
            files.load_snapshot(spark, f"file://{tmp_path}/{name}.json")
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": 1}))
    old = files.load_snapshot(spark, f"file://{tmp_path}/old.json")
    assert old["cards"].count() == old["dashboards"].count() == old["relations"].count() == 0


def test_policies(spark, tmp_path):
    good = {"version": 1, "rules": [{"name": "r", "decision": "warn", "when": {"all": []}}]}
    for name, text in (("good", json.dumps(good)), ("bad", json.dumps(good | {"version": 2})), ("text", "{{"), ("list", "[1]"), ("empty", "")):
        (tmp_path / name).write_text(text)
    at = lambda n: f"file://{tmp_path}/{n}"
    assert files.load_policy(spark, at("good")) == good
    assert files.load_policy(spark, None, (at("no"), at("good"), at("bad"))) == good and files.load_policy(spark, None, (at("no"),)) is None
    with pytest.raises(FileNotFoundError):
        files.load_policy(spark, at("no"), (at("good"),))
    for name in ("bad", "text", "list", "empty"):
        with pytest.raises(ValueError):
            files.load_policy(spark, at(name))
