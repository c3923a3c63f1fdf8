"""Order of day and month by elimination; dictionary joins of columns with frequent values."""

import datetime as dt

from pyspark.sql import functions as F

from fieldspark.operators.features import category_table, frequent_values, label_encode, label_encode_skewed
from fieldspark.sources.dates import date_orders, parse_ordered
from fieldspark.sources.ingest import ingest


def orders(spark, columns):
    rows = [(name, c) for name, cells in columns.items() for c in cells]
    return {r["name"]: r for r in date_orders(spark.createDataFrame(rows, "name string, cell string").repartition(3), ["name"]).collect()}


def test_cells_vote_orders_out(spark):
    got = orders(spark, {
        "day": ["01/02/2024", "13/02/2024", None, "", "2024-01-31", "45000"], "month": ["1/2/2024", "02/13/2024 10:30"], "unclear": ["01/02/2024", "03.04.2024", "5-6-2024"],
        "mixed": ["13/02/2024", "02/13/2024", "31/12/2024"], "no dates": ["2024-02-13", "abc", None], "impossible": ["13/14/2024", "01/02/2024", "0/5/2024", "40/1/2024"],
    })
    assert {k: r["date_order"] for k, r in got.items()} == {"day": "day", "month": "month", "unclear": "ambiguous", "mixed": "mixed", "impossible": "ambiguous"}
    assert (got["mixed"]["n_cells"], got["mixed"]["not_day_first"], got["mixed"]["not_month_first"]) == (3, 1, 2)
    assert got["impossible"]["n_cells"] == 1


def test_cells_are_read_in_their_order(spark):
    cells = spark.createDataFrame([("02/03/2024", "month"), ("02/03/2024", "day"), ("02/03/2024", None), ("02/13/2024", "month"), ("02/13/2024", "day"), ("2024-02-03", "month"), (None, "month"), ("45000", "month"), ("2-3-2024 10:30", "month")], "c string, o string")
    got = [r["d"] for r in cells.select(parse_ordered(F.col("c"), F.col("o")).alias("d")).collect()]
    march, february = dt.datetime(2024, 3, 2), dt.datetime(2024, 2, 3)
    assert got == [february, march, march, dt.datetime(2024, 2, 13), None, february, None, dt.datetime(2023, 3, 15), dt.datetime(2024, 2, 3, 10, 30)]


def test_ingest_reads_each_file_in_its_order(spark, tmp_path):
    head = "date,field_id,temp\n"
    (tmp_path / "eu.csv").write_text(head + "01/02/2024,a,1\n13/02/2024,b,1\n")
    (tmp_path / "us.csv").write_text(head + "01/02/2024,c,1\n02/13/2024,d,1\n")
    (tmp_path / "iso.csv").write_text(head + "2024-02-01,e,1\n")
    res = ingest(spark, str(tmp_path), ("date", "field_id", "temp"))
    assert {r["source_file"]: r["date_order"] for r in res.files.collect()} == {"eu.csv": "day", "us.csv": "month", "iso.csv": None}
    days = {r["field_id"]: (r["date"].month, r["date"].day) for r in res.df.collect()}
    assert days == {"a": (2, 1), "b": (2, 13), "c": (1, 2), "d": (2, 13), "e": (2, 1)} and "date_order" not in res.df.columns
    plain = ingest(spark, str(tmp_path), ("date", "field_id", "temp"), infer_date_order=False)
    assert plain.df.count() == 4 and plain.rejected.count() == 1


def test_codes_do_not_depend_on_the_way(spark):
    v = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 5000))
    df = spark.range(30_000).select("id", v.alias("tag"), (F.col("id") % 3).cast("int").alias("small")).repartition(6)
    got = label_encode_skewed(df, ["tag", "small"])
    want = label_encode(df, ["tag", "small"])
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    known = category_table(df.where("id < 100"), ["tag"])
    got, want = label_encode_skewed(df, ["tag"], categories=known), label_encode(df, ["tag"], categories=known)
    assert got.exceptAll(want).isEmpty() and got.where("tag_code is null").count() > 0


def test_frequent_values_do_not_move(spark):
    v = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
    df = spark.range(200_000).select(v.alias("tag"))
    often = {r["value"] for r in frequent_values(df, F.col("tag")).collect()}
    assert "hot" in often and len(often) <= 256
    rest = label_encode_skewed(df, ["tag"]).where("tag_code is not null")
    assert rest.count() == 200_000
    plan = label_encode_skewed(df, ["tag"])._jdf.queryExecution().optimizedPlan().toString()
    held = plan.split("Join LeftOuter")[0]  # the first branch of the union: an inner join by broadcast
    assert "strategy=broadcast" in held and "Join Inner" in held


def test_dates_and_serials_as_before(spark):
    """A text that begins like a date is not tried as a number; all others are."""
    import datetime as dt

    from fieldspark.functions.columns import normalise_date

    cells = ["2024-01-31", " 31/01/2024", "45322", " 45322.0 ", "45322d", "4.5322e4", "1e-5", "45322-", "45322/1", "n.d.", "", None, "2024/1/31 06:00:00+02:00"]
    got = spark.createDataFrame(list(enumerate(cells)), "id int, cell string").select("id", normalise_date("cell").alias("date")).orderBy("id").collect()
    day = dt.datetime(2024, 1, 31)
    assert [r["date"] for r in got] == [day, day, day, day, day, day, None, None, None, None, None, None, day.replace(hour=6)]
