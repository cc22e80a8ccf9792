import json

import pytest
from pyspark.sql import functions as F

from folioscope.sources import paged, pages


def collection(path):
    """A collection in one file, read as a service would answer."""

    def fetch(resource, offset, limit):
        rows = json.load(open(path))[resource]
        if offset in rows[0].get("lost", []):
            raise OSError("no answer")
        return json.dumps({"data": rows[offset : offset + limit], "totalCount": len(rows), "limit": limit, "offset": offset})

    return fetch


def write(path, n, lost=()):
    rows = [{"id": i + 1, "name": f"n{i}"} for i in range(n)]
    rows[0]["lost"] = list(lost)
    path.write_text(json.dumps({"customers": rows, "lawsuits": [{"id": 1}]}))


def load(spark, name, **options):
    reader = spark.read.format(name).option("resource", "customers").option("page_size", 10)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def test_ranges_of_pages_are_partitions(spark, tmp_path):
    write(tmp_path / "c", 95)
    paged.register(spark, "pages_a", collection(str(tmp_path / "c")))
    df = load(spark, "pages_a", pages_per_task=3)
    assert df.rdd.getNumPartitions() == 4
    found = pages.page_records(pages.parse_pages(df))
    ids = found.select(F.expr("variant_get(record, '$.id', 'bigint')").alias("id"))
    assert sorted(r.id for r in ids.collect()) == list(range(1, 96))
    scan = pages.check_scan(pages.parse_pages(df)).first()
    assert scan.complete and scan.pages == 10 and scan.records == 95


def test_filters_choose_pages_before_they_are_fetched(spark, tmp_path):
    write(tmp_path / "c", 95, lost=[0, 10, 20, 60, 70, 80, 90])
    fetch = collection(str(tmp_path / "c"))

    def only_wanted(resource, offset, limit):
        if offset == 30:
            return fetch(resource, offset, limit)
        if offset in (40, 50):
            return fetch(resource, offset, limit)
        raise SystemError(f"page {offset} isn't wanted")

    paged.register(spark, "pages_b", only_wanted)
    df = load(spark, "pages_b", from_offset=30)
    got = lambda condition: sorted(tuple(r) for r in df.filter(condition).select("requested_offset", F.col("payload").isNull()).collect())
    assert got("requested_offset > 30 and requested_offset <= 55") == [(40, False), (50, False)]
    assert got("requested_offset = 40 and resource = 'customers'") == [(40, False)]
    assert got("requested_offset >= 35 and requested_offset < 50") == [(40, False)]
    assert got("resource = 'lawsuits'") == [] and got("requested_offset = 41") == []
    assert got("requested_offset <= 40 and requested_limit = 10") == [(30, False), (40, False)]


def test_lost_pages_are_reported(spark, tmp_path):
    write(tmp_path / "c", 95, lost=[40])
    paged.register(spark, "pages_c", collection(str(tmp_path / "c")))
    df = load(spark, "pages_c")
    assert [r.requested_offset for r in df.filter("payload is null").collect()] == [40]
    scan = pages.check_scan(pages.parse_pages(df)).first()
    assert not scan.complete and scan.page_violations == 1 and scan.gaps == 1 and scan.records == 85


def test_stream_reads_what_the_collection_gained(spark, rows, tmp_path):
    paged.register(spark, "pages_d", collection(str(tmp_path / "c")))
    for n in (25, 25, 48):
        write(tmp_path / "c", n)
        stream = spark.readStream.format("pages_d").option("resource", "customers").option("page_size", "10").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert rows(found.select("requested_offset")) == [(0,), (10,), (20,), (25,), (35,), (45,)]
    records = pages.page_records(pages.parse_pages(found)).select(F.expr("variant_get(record, '$.id', 'bigint')").alias("id"))
    assert sorted(r.id for r in records.collect()) == list(range(1, 49))


def test_empty_collection_and_wrong_options(spark, tmp_path):
    (tmp_path / "c").write_text(json.dumps({"customers": []}))

    def fetch(resource, offset, limit):
        return json.dumps({"data": [], "totalCount": 0, "limit": limit, "offset": offset})

    paged.register(spark, "pages_e", fetch)
    assert pages.check_scan(pages.parse_pages(load(spark, "pages_e"))).first().complete
    for options in ({"page_size": 0}, {"from_offset": -1}):
        with pytest.raises(Exception, match="or more"):
            load(spark, "pages_e", **options).collect()
    paged.register(spark, "pages_f", lambda *_: "no page")
    with pytest.raises(Exception, match="no total"):
        load(spark, "pages_f").collect()


def test_a_landed_collection_has_a_file_for_many_pages(spark, rows, tmp_path):
    offset = F.col("id") * 100
    landed = spark.range(200).select(
        F.lit("customers").alias("resource"), offset.alias("requested_offset"), F.lit(100).alias("requested_limit"),
        F.concat(F.lit('{"data":[],"totalCount":20000,"limit":100,"offset":'), offset.cast("string"), F.lit("}")).alias("payload"),
    )
    folder = f"file://{tmp_path}/store"
    paged.land_pages(landed.filter("requested_offset <> 700"), folder)
    assert len(list(tmp_path.glob("store/**/part-*"))) == 4
    paged.register(spark, "pages_g", paged.from_folder(folder))
    found = load(spark, "pages_g", page_size=100)
    expected = landed.withColumn("payload", F.expr("if(requested_offset = 700, null, payload)"))
    assert rows(found.select("requested_offset", "payload")) == rows(expected.select("requested_offset", "payload"))
