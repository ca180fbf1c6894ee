"""Files in the formats the readers take."""

import json

import pytest
from pyspark.sql import functions as F

from foliotab.sources import model_files, readers, series


def test_line_numbers_over_blocks(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join(json.dumps({"event": "e", "n": i}) + "\n" if i % 50 else "broken {\n" for i in range(1, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_events(spark, str(p), "event string, n long")
        assert readers.text_lines(spark, str(p)).select("block").distinct().count() > 5
        got = {r["__line_number"]: (r.event, r.n) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: ("e", i) if i % 50 else ("parse_error", None) for i in range(1, 4001)}


def test_json_or_lines(spark, tmp_path):
    a, b, c = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    a.write_text('[\n {"id": 1},\n {"id": 2}\n]')
    b.write_text('{"id": 1}\n\n{"id": 2}\n')
    c.write_text('{"id": 1}\n{"id": oops\n')
    for p in (a, b):
        assert sorted(r.id for r in readers.read_json_or_lines(spark, str(p), "id long").collect()) == [1, 2]
    lists, both = tmp_path / "d.json", tmp_path / "both"
    lists.write_text('[{"id": 1}, {"id": 2}]\n[{"id": 3}]\n{"id": 4}\n')
    assert sorted(r.id for r in readers.read_json_or_lines(spark, str(lists), "id long").collect()) == [1, 2, 3, 4]
    both.mkdir()
    (both / "a.json").write_text(a.read_text())
    (both / "b.json").write_text(b.read_text().replace("1", "7"))
    assert sorted(r.id for r in readers.read_json_or_lines(spark, str(both), "id long").collect()) == [1, 2, 2, 7]
    (tmp_path / "e.json").write_text("{oops\n")
    with pytest.raises(Exception, match="line 1"):
        readers.read_json_or_lines(spark, str(tmp_path / "e.json"), "id long").collect()
    with pytest.raises(Exception, match="line 2"):
        readers.read_json_or_lines(spark, str(c), "id long").collect()


def test_multiline_log_keeps_incomplete_tail(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text('{"level": "a", "message": "one "two"\nthree"}\n{"level": "b", "message": "ok"}\n{"level": "c", "message": "cut')
    rows, errors = readers.read_multiline_log(spark, str(p), "level string, message string")
    assert sorted((r.start_line, r.end_line, r.message) for r in rows.collect()) == [(1, 2, "one 'two'\nthree"), (3, 3, "ok")]
    assert [(r.start_line, r.error) for r in errors.collect()] == [(4, "incomplete record")]


def test_results_shapes(spark, tmp_path):
    (tmp_path / "1.json").write_text('[[{"question_id": "q", "v": 1}], [{"level": "m"}]]')
    (tmp_path / "2.json").write_text('[{"question_id": "q", "v": 2}, {"question_id": "r", "v": 3}]')
    (tmp_path / "3.json").write_text('{"results": [{"question_id": "s", "v": 4}], "metadata": [{"level": "n"}]}')
    d = readers.read_results(spark, str(tmp_path), "struct<question_id: string, v: int>", "struct<level: string>")
    assert sorted((r.question_id, r.v, r.metadata.level if r.metadata else None) for r in d.collect()) == [("q", 1, "m"), ("q", 2, None), ("r", 3, None), ("s", 4, "n")]


def test_documents_and_files(spark, tmp_path):
    (tmp_path / "b.md").write_bytes(b"ok \xff end")
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "c.bin").write_text("no")
    d = readers.read_documents(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.document_name, r.content) for r in d] == [("b.md", "ok � end"), ("a.txt", "text")]
    assert readers.list_files(spark, str(tmp_path)).count() == 3


def test_dataset_suffix(spark):
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.xml")


def test_resolve_documents_prefix(spark):
    q = spark.createDataFrame([(1, ["ACME", "NONE"], "2024-"), (2, ["ACME"], "")], "question_id int, doc array<string>, p string")
    f = spark.createDataFrame([("10K-ACME-x.txt",), ("2024-ACME.txt",), ("a.ACME",)], "name string")
    found, missing = readers.resolve_documents(q, f, prefix=F.col("p"))
    assert {(r.question_id, r.file) for r in found.collect()} == {(1, "2024-ACME.txt"), (2, "10K-ACME-x.txt")}
    assert [r.wanted for r in missing.collect()] == ["NONE"]


def test_model_file(spark, tmp_path):
    p = tmp_path / "m.idf"
    p.write_text("! head\nVersion,9.0;\n\nZone,\n  West, !- Name\n  ,     !- Direction of Relative North {deg}\n  3.5;  !- Floor Area {m2}\nSchedule:Compact, S, Fraction, Through: 12/31, For: AllDays, Until: 24:00,1.0;\n")
    rows = [(r.obj_type, r.obj_idx, r.field_idx, r.field_name, r.value) for r in model_files.read_model_objects(spark, str(p)).orderBy("obj_idx", "field_idx").collect()]
    assert rows[:4] == [("Version", 0, 0, "Field_1", "9.0"), ("Zone", 1, 0, "Name", "West"), ("Zone", 1, 1, "Direction_of_Relative_North", ""), ("Zone", 1, 2, "Floor_Area", "3.5")]
    from foliotab.operators.schedules import compact_points

    o = model_files.read_model_objects(spark, str(p)).filter("obj_type = 'Schedule:Compact' and field_idx >= 2")
    got = compact_points(o, ["model", "obj_idx"]).collect()
    assert [(r.period, r.day_type, r.minute, r.value) for r in got] == [("12/31", "AllDays", 1440, 1.0)]


def test_dictionaries_both_forms(spark, tmp_path):
    (tmp_path / "a.mdd").write_text("! x\nOutput:Meter,Electricity:Facility,hourly; !- [J]\nOutput:Meter:Cumulative,Electricity:Facility,hourly; !- [J]\nOutput:Meter,Water:Mains,daily; !- [m3]\n")
    (tmp_path / "b.mdd").write_text("Program Version,9\nVar Type (reported time step),Var Report Type,Variable Name [Units]\nZone,Meter,Gas [x] [J]\nZone,Average,No [C]\n")
    m = model_files.read_meter_dictionary(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.unit, r.frequency, r.resource_type) for r in m) == [("Electricity:Facility", "J", "hourly", "Electricity"), ("Gas [x]", "J", "hourly", "Other"), ("Water:Mains", "m3", "daily", "MainsWater")]
    r = tmp_path / "v"
    r.mkdir()
    (r / "a.rdd").write_text("Output:Variable,*,Zone Air Temperature,hourly; !- Zone Average [C]\n")
    (r / "b.rdd").write_text("Var Type (reported time step),Var Report Type,Variable Name [Units]\nHVAC,Sum,Boiler Energy [J]\n")
    v = model_files.read_variable_dictionary(spark, str(r)).collect()
    assert sorted((x.name, x.unit, x.var_type) for x in v) == [("Boiler Energy", "J", "HVAC"), ("Zone Air Temperature", "C", "Zone")]


def test_series(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("Date/Time,Z1:Temp [C](Hourly),Z1:Load [W]\n 01/31  23:00:00,1.5,10\n 01/31  24:00:00,2.5,\nCoinc Peak,9\n")
    got = [(r.row, str(r.time), r.series, r.unit, r.value) for r in series.read_series(spark, str(p)).orderBy("row", "series").collect()]
    assert got == [(0, "2000-01-31 23:00:00", "Z1:Load", "W", 10.0), (0, "2000-01-31 23:00:00", "Z1:Temp", "C", 1.5), (1, "2000-02-01 00:00:00", "Z1:Temp", "C", 2.5)]


def test_series_of_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Time,"Z1, east:Temp [C]",Load [W]\n01/02 03:00:00,"1.5",2\n')
    (tmp_path / "b.csv").write_text("Gas [J],Date/Time\n7,01/02 03:00:00\n8,Total\n")
    got = [(r.file[-5:], r.row, r.series, r.unit, r.value) for r in series.read_series(spark, str(tmp_path)).orderBy("file", "row", "series").collect()]
    assert got == [("a.csv", 0, "Load", "W", 2.0), ("a.csv", 0, "Z1, east:Temp", "C", 1.5), ("b.csv", 0, "Gas", "J", 7.0), ("b.csv", 1, "Gas", "J", 8.0)]


def test_results_use_an_items_own_metadata(spark, tmp_path):
    (tmp_path / "1.json").write_text('[{"question_id": "q", "v": 1, "metadata": {"level": "own"}}]')
    (tmp_path / "2.json").write_text('{"results": [{"question_id": "q", "v": 2}], "misc_question_metadata": [{"level": "misc"}]}')
    d = readers.read_results(spark, str(tmp_path), "struct<question_id: string, v: int>", "struct<level: string>")
    assert sorted((r.question_id, r.v, r.metadata.level) for r in d.collect()) == [("q", 1, "own"), ("q", 2, "misc")]
