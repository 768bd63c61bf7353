import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import (
    to_document,
    ConcurrentChange,
    Lakehouse,
    RejectedRows,
    SnapshotNotFound,
    TableNotFound,
    conform,
    to_struct,
)

SAMPLE = json.dumps(
    {
        "type": "struct",
        "fields": [
            {"id": 4, "name": "shelf", "type": "long", "required": True},
            {"id": 6, "name": "label", "type": "string", "required": False},
        ],
    }
)


def rows_of(frame):
    return sorted(tuple(row) for row in frame.collect())


def test_creating_a_table_shows_in_both_registries_and_it_can_be_selected(spark, lake, namespace):
    assert lake.create_namespace(namespace, '{"team": "a\'b", "size": 3}') == namespace
    made = lake.create_table(namespace, "test", SAMPLE)
    # The names of both relations and of their columns.
    declared = spark.table("test_catalog.table_schemas").where(F.col("table_uuid") == made.table_uuid)
    declared = declared.select("field_position", "field_name", "field_type")
    assert rows_of(declared) == [(1, "shelf", "long"), (2, "label", "string")]
    listed = spark.table("test_catalog.tables_internal").where(F.col("namespace") == namespace)
    listed = listed.select("table_name", "table_uuid", "metadata_location")
    assert rows_of(listed) == [("test", made.table_uuid, made.metadata_location)]
    selected = spark.sql(f"SELECT * FROM {namespace}.test")
    assert selected.columns == ["shelf", "label"] and selected.count() == 0
    properties = spark.sql(f"DESCRIBE NAMESPACE EXTENDED {namespace}").collect()
    assert any("a'b" in str(row) for row in properties)


def test_appends_and_pinned_reads(spark, lake, namespace):
    empty = lake.create_table(namespace, "t", SAMPLE)
    first = lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label")).state
    second = lake.append(namespace, "t", spark.sql("SELECT 2 AS shelf, NULL AS label")).state
    assert (first.snapshot_seq, second.snapshot_seq, second.total_rows) == (1, 2, 2)
    read = lambda state: rows_of(lake.scan(namespace, "t", state.metadata_location))
    assert read(empty) == []
    assert read(first) == [(1, "x")]
    assert sorted(lake.scan(namespace, "t").collect()) == sorted(
        spark.sql(f"SELECT * FROM {namespace}.t").collect()
    )
    assert lake.scan(namespace, "t").count() == 2
    with pytest.raises(SnapshotNotFound):
        lake.scan(namespace, "t", second.metadata_location + "9")
    with pytest.raises(TableNotFound):
        lake.scan(namespace, "absent")
    with pytest.raises(ValueError, match="exists"):
        lake.create_table(namespace, "t", SAMPLE)


def test_a_pinned_read_prunes_by_snapshot_and_reads_only_named_columns(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    state = lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label")).state
    plan = lake.scan_state(state).where("shelf = 1").select("shelf")
    text = plan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(snapshot_seq" in text
    assert "PushedFilters: [IsNotNull(shelf), EqualTo(shelf,1)]" in text
    assert "ReadSchema: struct<shelf:bigint>" in text


def test_a_view_follows_the_newest_snapshot_and_still_prunes(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    view = f"SELECT shelf FROM {namespace}.t WHERE label = 'x'"
    for number in (1, 2):
        lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label"))
        assert spark.sql(view).count() == number
    plan = spark.sql(view)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_seq" in plan and "Subquery" in plan
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,x)]" in plan


def test_a_refused_append_publishes_nothing_and_can_be_run_again(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label"))
    bad = spark.createDataFrame([("2", "y"), ("two", "z"), (None, "w")], "shelf string, label string")
    with pytest.raises(RejectedRows) as refused:
        lake.append(namespace, "t", bad)
    assert refused.value.rejected == 2
    assert refused.value.counts == {"shelf: lost in cast": 1, "shelf: required is null": 1}
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x")]
    split = lake.append(namespace, "t", bad, on_reject="split")
    assert (split.state.snapshot_seq, split.state.total_rows) == (2, 2)
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x"), (2, "y")]
    reasons = {row["label"]: row["_problems"] for row in split.rejects.collect()}
    assert reasons == {"z": ["shelf: lost in cast"], "w": ["shelf: required is null"]}


def test_files_an_append_left_behind_are_never_read(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    state = lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label")).state
    stray = spark.sql("SELECT 7 AS shelf, 'dead' AS label").withColumn("shelf", F.col("shelf").cast("long"))
    stray.write.parquet(f"{state.table_path}/snapshot_seq=2")
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x")]
    assert rows_of(spark.sql(f"SELECT * FROM {namespace}.t")) == [(1, "x")]
    lake.append(namespace, "t", spark.sql("SELECT 2 AS shelf, 'y' AS label"))
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x"), (2, "y")]


def test_a_creation_that_never_finished_can_be_run_again(spark, lake, namespace):
    dead = f"{lake.root}/registry/tables/namespace={namespace}/table_name=t/snapshot_seq=0"
    spark.range(0).selectExpr("CAST(id AS STRING) AS table_uuid").write.parquet(dead)
    with pytest.raises(SnapshotNotFound):
        lake.scan(namespace, "t")
    lake.create_table(namespace, "t", SAMPLE)
    assert lake.scan(namespace, "t").count() == 0


def test_another_session_object_finds_the_same_tables(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label"))
    spark.sql(f"DROP VIEW {namespace}.t")
    lake.append(namespace, "t", spark.sql("SELECT 2 AS shelf, 'y' AS label"))
    assert spark.table(f"{namespace}.t").count() == 2
    spark.sql(f"DROP VIEW {namespace}.t")
    again = Lakehouse(spark, lake.root, "test_catalog")
    again.refresh_views()
    assert rows_of(spark.sql(f"SELECT * FROM {namespace}.t")) == [(1, "x"), (2, "y")]


def test_names_that_could_leave_their_folder_are_refused(lake, namespace):
    for name in ("a/b", "a.b", "1a", "", "a b", "x`y"):
        with pytest.raises(ValueError):
            lake.create_table(namespace, name, SAMPLE)


def test_columns_must_match_the_declaration(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    with pytest.raises(ValueError, match="not declared"):
        lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 2 AS other"))
    with pytest.raises(ValueError, match="absent"):
        lake.append(namespace, "t", spark.sql("SELECT 'x' AS label"))
    lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf"))
    assert rows_of(lake.scan(namespace, "t")) == [(1, None)]


def test_nested_values_are_checked_to_their_depth(spark):
    document = {
        "type": "struct",
        "fields": [
            {
                "id": 1,
                "name": "v",
                "type": {
                    "type": "list",
                    "element-id": 2,
                    "element": "float",
                    "element-required": True,
                },
            },
            {
                "id": 3,
                "name": "s",
                "type": {
                    "type": "struct",
                    "fields": [{"id": 4, "name": "x", "type": "int", "required": True}],
                },
            },
            {
                "id": 5,
                "name": "m",
                "type": {
                    "type": "map",
                    "key-id": 6,
                    "key": "string",
                    "value-id": 7,
                    "value": "long",
                    "value-required": True,
                },
            },
        ],
    }
    rows = spark.createDataFrame(
        [
            (0, ["1", "2"], ("3",), {"a": "4"}),
            (1, ["1", None], ("3",), {"a": "4"}),
            (2, ["1", "b"], ("3",), {"a": "4"}),
            (3, ["1"], ("c",), {"a": "4"}),
            (4, ["1"], (None,), {"a": "4"}),
            (5, ["1"], ("3",), {"a": "d"}),
            (6, ["1"], ("3",), {"a": None}),
            (7, None, None, None),
        ],
        "n int, v array<string>, s struct<x: string>, m map<string, string>",
    )
    document["fields"].append({"id": 8, "name": "n", "type": "int"})
    checked = conform(rows, to_struct(document))
    assert sorted(row["n"] for row in checked.accepted.collect()) == [0, 7]
    reasons = {row["n"]: row["_problems"] for row in checked.rejects.collect()}
    assert reasons == {
        1: ["v: required is null"],
        2: ["v: lost in cast"],
        3: ["s: lost in cast"],
        4: ["s: required is null"],
        5: ["m: lost in cast"],
        6: ["m: required is null"],
    }


def test_uuid_and_fixed_lengths_are_checked(spark):
    document = {
        "type": "struct",
        "fields": [
            {"id": 1, "name": "u", "type": "uuid"},
            {"id": 2, "name": "b", "type": "fixed[2]"},
        ],
    }
    good = "123e4567-e89b-12d3-a456-426614174000"
    rows = spark.createDataFrame(
        [(good, bytearray(b"ab")), ("no", bytearray(b"ab")), (good, bytearray(b"a")), (None, None)],
        "u string, b binary",
    )
    checked = conform(rows, to_struct(json.dumps(document)))
    assert checked.accepted.count() == 2
    assert sorted(row["_problems"][0] for row in checked.rejects.collect()) == [
        "b: bad format",
        "u: bad format",
    ]


def test_values_that_a_cast_would_round_are_refused_unless_allowed(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    rows = spark.sql("SELECT 1.7D AS shelf, 'x' AS label UNION ALL SELECT 2.0D, 'y'")
    with pytest.raises(RejectedRows):
        lake.append(namespace, "t", rows)
    done = lake.append(namespace, "t", rows, on_reject="split")
    assert rows_of(lake.scan(namespace, "t")) == [(2, "y")]
    assert [row["shelf"] for row in done.rejects.collect()] == [1.7]
    lake.append(namespace, "t", rows, lossy="allow")
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x"), (2, "y"), (2, "y")]


def test_of_two_appends_at_once_the_second_fails_and_loses_nothing(
    spark, lake, namespace, monkeypatch
):
    before = lake.create_table(namespace, "t", SAMPLE)
    lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label"))
    late = spark.sql("SELECT 2 AS shelf, 'y' AS label")
    with monkeypatch.context() as patch:
        patch.setattr(lake, "state", lambda *_: before)
        with pytest.raises(ConcurrentChange):
            lake.append(namespace, "t", late)
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x")]
    lake.append(namespace, "t", late)
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x"), (2, "y")]


def test_a_claim_keeps_others_out_until_it_is_taken_over(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    rows = spark.sql("SELECT 1 AS shelf, 'x' AS label")
    lake._claim(lake.state(namespace, "t"), take_over=False)  # an append that is killed
    with pytest.raises(ConcurrentChange, match="under way"):
        lake.append(namespace, "t", rows)
    lake.append(namespace, "t", rows, take_over=True)
    assert rows_of(lake.scan(namespace, "t")) == [(1, "x")]


def test_of_two_index_events_at_once_the_second_fails(lake, namespace, monkeypatch):
    lake.create_table(namespace, "t", SAMPLE)
    event = dict.fromkeys(lake.index_events().columns) | {"event": "drop", "index_name": "a"}
    lake.record_index_event(namespace, "t", event)
    monkeypatch.setattr(lake, "_last", lambda *_: 0)
    with pytest.raises(ConcurrentChange):
        lake.record_index_event(namespace, "t", event | {"index_name": "b"})
    names = lake.index_events_of(namespace, "t").select("index_name")
    assert rows_of(names) == [("a",)]


def test_a_pinned_scan_lists_no_later_snapshot(spark, lake, namespace):
    lake.create_table(namespace, "t", SAMPLE)
    first = lake.append(namespace, "t", spark.sql("SELECT 1 AS shelf, 'x' AS label")).state
    for _ in range(3):
        lake.append(namespace, "t", spark.sql("SELECT 2 AS shelf, 'y' AS label"))
    files = lake.scan(namespace, "t", first.metadata_location).inputFiles()
    assert {file.split("/")[-2] for file in files} == {"snapshot_seq=0", "snapshot_seq=1"}
    assert lake.state(namespace, "t").snapshot_seq == 4


def test_good_and_refused_rows_add_up_though_the_input_never_repeats(spark, lake, namespace):
    """The input is random and has a name like that of the working column."""
    schema = spark.createDataFrame([], "id long, x double, _refused int").schema
    document = json.loads(to_document(schema))
    document["fields"][1]["required"] = True
    lake.create_table(namespace, "t", json.dumps(document))
    drawn = F.when(F.rand() < 0.5, F.lit(None)).otherwise(F.rand())
    rows = spark.range(3000).select("id", drawn.alias("x"), F.lit(7).alias("_refused"))
    done = lake.append(namespace, "t", rows, on_reject="split")
    good = {row["id"] for row in lake.scan(namespace, "t").select("id").collect()}
    for _ in range(2):
        refused = {row["id"] for row in done.rejects.collect()}
        assert good | refused == set(range(3000)) and not good & refused
    assert done.state.total_rows == len(good) and 1000 < len(good) < 2000
    assert done.rejects.columns == ["id", "x", "_refused", "_problems"]
    none = lake.append(namespace, "t", rows.where("false"), on_reject="split")
    assert none.state.total_rows == len(good) and none.rejects.count() == 0
