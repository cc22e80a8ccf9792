import glob
import pathlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import page_index

SCHEMA = "id bigint, name string"


def order():
    return [F.col("name").asc_nulls_first(), F.col("id").desc()]


@pytest.mark.parametrize("range_rows", [1, 13, 1000])
def test_every_page_is_found_in_its_range(spark, tmp_path, range_rows):
    rows = [(i, None if i % 11 == 0 else f"n{i % 7}") for i in range(100)]
    wanted = sorted(rows, key=lambda r: (r[1] or "", -r[0]))
    folder = str(tmp_path / "index")
    page_index.write_index(spark.createDataFrame(rows, SCHEMA).repartition(4), order(), folder, range_rows)
    for number, size in ((1, 10), (4, 10), (10, 10), (11, 10), (-3, 10), (3, 33), (4, 33), (1, 500)):
        found = page_index.read_page(spark, folder, order(), number, size)
        pages = -(-100 // size)
        at = min(max(number, 1), pages)
        got = sorted(((r.id, r["name"]) for r in found.collect()), key=repr)
        assert got == sorted(wanted[(at - 1) * size : at * size], key=repr)
        assert {(r.page, r.pages, r.total_rows) for r in found.collect()} == {(at, pages, 100)}


def test_other_ranges_are_not_opened(spark, tmp_path):
    folder = str(tmp_path / "index")
    page_index.write_index(spark.createDataFrame([(i, f"n{i:04}") for i in range(500)], SCHEMA), order(), folder, 50)
    page = page_index.read_page(spark, folder, order(), 24, 10)
    kept = {r["_range"] for r in spark.read.parquet(f"{folder}/rows").filter("id between 230 and 239").select("_range").distinct().collect()}
    assert 1 <= len(kept) <= 2
    for file in glob.glob(f"{folder}/rows/_range=*/*.parquet"):
        if int(file.split("_range=")[1].split("/")[0]) not in kept:
            pathlib.Path(file).write_bytes(b"not parquet")
    assert sorted(r.id for r in page.collect()) == list(range(230, 240))


def test_empty_list_has_one_empty_page(spark, tmp_path):
    folder = str(tmp_path / "index")
    page_index.write_index(spark.createDataFrame([], SCHEMA), order(), folder)
    assert page_index.read_page(spark, folder, order(), 7, 10).collect() == []
