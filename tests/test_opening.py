"""How often a record is walked, and under which limit of generated methods."""

import json

from pyspark.sql import functions as F

from folioscope.functions import scalars as s
from folioscope.session import METHOD_LIMIT
from folioscope.sources import normalize, pages


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _records(spark, *rows):
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in rows]
    return spark.createDataFrame(texts, "raw string").select(F.parse_json("raw").alias("record"))


def test_a_record_is_walked_once_for_its_values_and_once_for_its_texts(spark):
    raw = _records(spark, {"a": 'x"\n\\ ', "b": 1.50, "c": {"d": [1]}, "e": None, "f": ""}, "[1]", "null")
    opened = s.open_record(raw, list("abcdefg"))
    assert _plan(opened).count("try_variant_get") == 2
    found = [[r[f"_{n}_text"] for n in "abcdefg"] for r in opened.collect()]
    assert found == [['x"\n\\ ', "1.5", '{"d":[1]}', None, "null", "", None], [None] * 7, [None] * 7]


def test_a_session_with_the_default_limit_gets_small_methods(spark):
    before = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.unset(METHOD_LIMIT)
        s.open_record(_records(spark, {"a": 1}), ["a"])
        assert spark.conf.get(METHOD_LIMIT) == "8000"
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def test_references_are_counted_once(spark):
    cases = _records(
        spark, {"customers": [{"customer_id": 1}, {"customer_id": 1}, {"customer_id": "a "}, {"customer_id": 9}, {}, 5, {"customer_id": None}]},
        {"customers": {}}, {}, {"customers": [{"customer_id": 9}]},
    )
    found = normalize.missing_relationships(cases, _records(spark, {"id": 1}, {"id": 1}, {"id": "a"}, {"id": 2}))
    assert "Subquery" not in _plan(found)
    assert tuple(found.first()) == (5, 1)
    assert tuple(normalize.missing_relationships(cases.limit(0), cases).first()) == (None, 0)


def test_pages_with_foreign_records(spark):
    rows = [(0, '{"data":[{},{"a":1}],"totalCount":2,"limit":2,"offset":0}'), (2, '{"data":[{},5],"totalCount":4,"limit":2,"offset":2}'), (4, "[]")]
    landed = spark.createDataFrame([(o, 2, p) for o, p in rows], "requested_offset bigint, requested_limit bigint, payload string")
    checked = pages.check_pages(pages.parse_pages(landed))
    assert "map<string,variant>" not in _plan(checked)
    assert {r["requested_offset"]: r["violation"] for r in checked.collect()} == {0: None, 2: "record_invalid", 4: "not_an_object"}
