import json

from pyspark.sql import functions as F

from folioforge.sources import records


def test_rows_are_rendered_with_a_limit_line(spark):
    rows = [("a", i, json.dumps({"t": f"row {i}", "x": {"y": [1, "z"]}})) for i in range(5)] + [("b", 1, json.dumps({"t": "only"})), ("c", 1, "{}"), (None, 1, json.dumps({"t": "no key"})), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, n int, record string").repartition(3)
    got = {r["k"]: r["rendered"] for r in records.render_rows(df, "k", "record", "{t|upper}", 2, [F.asc("n")], "nothing").collect()}
    assert got == {"a": "ROW 0\nROW 1\n… and 3 more", "b": "ONLY", "c": "nothing", None: "NO KEY"}
    assert records.render_rows(df.limit(0), "k", "record", "{t}", 2, [F.asc("n")]).count() == 0


def test_json_filter(spark):
    values = [{"x": {"y": [1, "z"]}}, {"x": "text"}, {"x": 2.5}, {"x": None}, {"z": 1}, {"x": "é" * 400}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [("not json",)], "record string")
    got = [r[0] for r in df.select(records.line(F.col("record"), "v={x|json}")).collect()]
    assert got[:5] == ['v={"y":[1,"z"]}', 'v="text"', "v=2.5", "v=null", "v=null"]
    assert got[5] == "v=" + ('"' + "é" * 400 + '"')[:300] and got[6] == "v=null"
