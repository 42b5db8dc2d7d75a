"""Texts are parsed once a row: a filter on coordinates does not take the parsing in."""

from pyspark.sql import functions as F


def test_keyed_objects_are_parsed_once(spark):
    from terraloom.sources.scan import keyed_truth

    texts = spark.createDataFrame([('{"a": {"lat": 1, "lon": "2"}, "b": {"latitude": 91, "lon": 2}, "c": {"lat": "x"}, "d": 5}', 1), ("{", 2), (None, 3)], "text string, n int")
    truth = keyed_truth(texts, "text", "n")
    assert truth._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 2
    assert [tuple(r) for r in truth.collect()] == [("a", 1.0, 2.0, "ungrouped")]


def test_points_parse_a_coordinate_once(spark):
    from terraloom.sources.scan import points

    rows = spark.createDataFrame([("p", "1.5", "2"), ("p", "nan", "2"), ("p", None, "2"), (" ", "1", "2"), ("p", "1", "181")], "path string, lat string, lon string")
    ok, bad = points(rows)
    assert "try_cast" not in ok._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert [tuple(r) for r in ok.collect()] == [("p", 1.5, 2.0)] and ok.columns == ["path", "lat", "lon"]
    assert bad.columns == ["path", "lat", "lon", "reason"]
    assert sorted(r["reason"] for r in bad.select(F.col("reason")).collect()) == ["no coordinates", "no coordinates", "no path", "out of range"]
