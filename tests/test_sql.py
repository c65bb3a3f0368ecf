"""SQL text: parameters, frames, templates, and text written for another engine."""

import pytest

from pelorus.sources.sql import filled, query, spark_text, template


def test_parameters_and_frames(spark):
    df = query(spark, "SELECT id, :x AS x FROM {t} WHERE id > :low;", {"x": "it's", "low": 0}, {"t": spark.range(3)})
    assert [tuple(r) for r in df.collect()] == [(1, "it's"), (2, "it's")]
    seen = []
    query(spark, "SELECT 1 AS a", setup=seen.append)
    assert seen == [spark]


def test_spelling_of_another_engine(spark, tmp_path):
    spark.createDataFrame([(1, 2.5, "a"), (2, None, None)], "widget_id int, value double, name string").write.parquet(str(tmp_path / "w.parquet"))
    text = """-- "comment" ::VARCHAR
    SELECT widget_id::BIGINT AS widget_id, value::VARCHAR AS "the value", CAST(name AS TEXT) AS timestamp, '::VARCHAR "x"' AS kept, SUM(widget_id) OVER ()::BIGINT AS total
    FROM read_parquet('{{ path }}') WHERE widget_id > {{ least }} ORDER BY widget_id NULLS LAST;
    """
    sql = spark_text(filled(text, {"path": str(tmp_path / "w.parquet"), "least": 0}))
    df = query(spark, sql)
    assert df.dtypes == [("widget_id", "bigint"), ("the value", "string"), ("timestamp", "string"), ("kept", "string"), ("total", "bigint")]
    assert [tuple(r) for r in df.collect()] == [(1, "2.5", "a", '::VARCHAR "x"', 3), (2, None, None, '::VARCHAR "x"', 3)]
    values = query(spark, spark_text("SELECT c1::INTEGER AS id, c2::VARCHAR AS name FROM (VALUES (1, 'alpha'), (2, 'beta')) AS t(c1, c2);"))
    assert [tuple(r) for r in values.collect()] == [(1, "alpha"), (2, "beta")]


def test_places_are_literals(spark):
    sql = filled("SELECT {{ a }} AS a, '{{ b }}' AS b, {{ c }} AS c, {{ d }} AS d", {"a": "x'; DROP TABLE t", "b": "it's", "c": None, "d": True})
    assert tuple(query(spark, sql).first()) == ("x'; DROP TABLE t", "it's", None, True)
    for values, error in (({}, KeyError), ({"a": []}, TypeError)):
        with pytest.raises(error):
            filled("{{ a }}", values)


def test_missing_template():
    with pytest.raises(FileNotFoundError):
        template("nothing.sql", "pelorus")
