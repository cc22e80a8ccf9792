import datetime as dt
import json
import time
import unicodedata
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.functions import formats
from folioscope.functions import scalars as s
from folioscope.operators import coverage, profile
from folioscope.sources import normalize, pages, sinks, synthetic, tables


def _records(spark, *objects):
    df = spark.createDataFrame([(i, json.dumps(o) if not isinstance(o, str) else o) for i, o in enumerate(objects)], "seq long, j string")
    return df.select("seq", F.parse_json("j").alias("record"))


def _value(spark, expression, value=None, schema="string"):
    return spark.createDataFrame([(value,)], f"v {schema}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "value", "error"),
    [
        (5, 5, None), (None, None, None), ("", None, None), (0, None, None), (False, None, None),
        (True, None, "v_invalid"), ("5", None, "v_invalid"), (-1, None, "v_invalid"), (1.5, None, "v_invalid"), ({}, None, "v_invalid"),
    ],
)
def test_positive_id(spark, raw, value, error):
    opened = s.open_record(_records(spark, {"v": raw}), ["v"])
    row = opened.select(s.positive_id(s.opened("v")).alias("v"), s.positive_id_error(s.opened("v"), "v").alias("e")).first()
    assert (row["v"], row["e"]) == (value, error)


@pytest.mark.parametrize(
    ("raw", "value", "error"),
    [("1500.5", Decimal("1500.50"), None), ("7", Decimal("7.00"), None), ('"9"', None, "v_invalid"), ("true", None, "v_invalid"), ("null", None, None)],
)
def test_money(spark, raw, value, error):
    opened = s.open_record(_records(spark, f'{{"v":{raw}}}'), ["v"])
    row = opened.select(s.money(s.opened("v")).alias("v"), s.money_error(s.opened("v"), "v").alias("e")).first()
    assert (row["v"], row["e"]) == (value, error)


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("2026-01-01T12:00:00Z", dt.datetime(2026, 1, 1, 12)),
        ("2026-01-01 12:00:00", dt.datetime(2026, 1, 1, 15)),
        ("2026-01-01T12:00", dt.datetime(2026, 1, 1, 15)),
        ("2026-01-01", dt.datetime(2026, 1, 1, 3)),
        ("2026-01-01T12:00:00.5-03:00", dt.datetime(2026, 1, 1, 15, 0, 0, 500000)),
        ("2026-02-30", None),
        ("soon", None),
    ],
)
def test_iso_timestamp(spark, raw, value):
    assert _value(spark, s.iso_timestamp_text, raw) == value


def test_text_functions(spark):
    assert _value(spark, lambda c: s.short(c, 5), "  a  b\n\tcdefg ") == "a b c"
    assert _value(spark, s.folder_key, " é ") == unicodedata.normalize("NFC", "é")
    assert _value(spark, s.folder_key, " ") is None
    assert _value(spark, s.case_number, " 1234567-89.2026.1.23.4567 ") == "12345678920261234567"
    assert _value(spark, s.case_number, "1234567-89.2026.1.23.456") is None
    assert _value(spark, s.label, " taxas   bancárias") == "TAXAS BANCÁRIAS"
    assert _value(spark, s.deterministic_id, "abc:v1:1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc:v1:1"))
    assert _value(spark, s.parse_percent, " 12,345% ") == Decimal("12.34")
    assert _value(spark, s.parse_percent, "100,01") is None
    assert _value(spark, s.valid_display_name, " Ana \n Lima ") == "Ana Lima"
    assert _value(spark, s.valid_display_name, "A\u0007na") is None
    assert _value(spark, s.iso_date_text, "2026-01-31T10:00") == dt.date(2026, 1, 31)


def test_months_and_periods(spark):
    def run(expression):
        return spark.range(1).select(expression).first()[0]

    leap = F.lit("2024-02-29 10:20:30").cast("timestamp")
    assert run(s.months_before(leap, 12)) == dt.datetime(2023, 2, 28, 10, 20, 30)
    today = F.lit("2026-09-21").cast("date")
    period = run(s.month_period(F.lit("2026-09"), today))
    assert tuple(period) == (dt.date(2026, 9, 1), dt.date(2026, 9, 21))
    assert run(s.month_period(F.lit("2026-10"), today)) is None
    assert run(s.recent_months(today, 3)) == ["2026-09", "2026-08", "2026-07"]
    assert run(s.local_day_key(F.lit("2026-01-01 02:00:00").cast("timestamp"))) == "daily-2025-12-31"


def test_formats(spark):
    def run(expression):
        return spark.range(1).select(expression).first()[0]

    assert run(formats.format_money(F.lit("-1234567.5").cast("decimal(18,2)"))) == "-R$ 1.234.567,50"
    assert run(formats.format_percent(F.lit("12.50").cast("decimal(5,2)"))) == "12,5%"
    assert run(formats.format_percent(F.lit("10.00").cast("decimal(5,2)"))) == "10%"
    assert run(formats.format_case_number(F.lit("12345678920261234567"))) == "1234567-89.2026.1.23.4567"


def test_cases_keep_the_last_name_per_id(spark):
    record = {
        "id": 10,
        "customers": [
            {"customer_id": 9, "name": " A  B "}, {"customer_id": 2, "name": None}, {"customer_id": 9, "name": "C"}, {"customer_id": 0, "name": 5},
        ],
    }
    row = normalize.normalize_cases(_records(spark, record)).first()
    assert row["errors"] == [] and row["customer_ids"] == [2, 9] and row["customer_names"] == {2: None, 9: "C"}


def test_malformed_case_stays_matchable_by_identifiers(spark):
    raw = _records(spark, {"id": 1, "folder": "F", "step": 5, "customers": [{"customer_id": 3}, {"customer_id": "x"}]}, {"id": "1"})
    first, second = normalize.with_identifier_fallback(raw).orderBy("seq").collect()
    assert first["identifiers_only"] and first["folder"] == "F" and first["customer_ids"] == [3] and first["errors"] == []
    assert second["errors"] == ["id_invalid"]


def test_fingerprint_depends_on_case_instant_and_title(spark):
    raw = _records(
        spark,
        {"lawsuit_id": 1, "date": "2026-01-01T12:00:00Z", "title": "a"},
        {"lawsuit_id": 1, "date": "2026-01-01T09:00:00-03:00", "title": "a"},
        {"lawsuit_id": 1, "date": "2026-01-01T12:00:00Z", "title": ""},
        {"lawsuit_id": 2, "date": "2026-01-01T12:00:00Z", "title": "a"},
    )
    prints = [r["fingerprint"] for r in normalize.normalize_movements(raw).orderBy("seq").collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_pages_from_files_and_duplicates(spark, tmp_path):
    page = {"data": [{"id": 1}, {"id": 1}, "invalid"], "totalCount": 3, "limit": 100, "offset": 0}
    bad = {"data": [{"id": 1}, {"id": "x"}, {"id": 1}], "totalCount": 3, "limit": 100, "offset": 0}
    lines = [
        json.dumps({"resource": r, "requested_offset": 0, "requested_limit": 100, "payload": json.dumps(p)})
        for r, p in (("broken", page), ("customers", bad))
    ]
    (tmp_path / "landed.json").write_text("\n".join(lines))
    broken = pages.read_pages(spark, str(tmp_path), "broken")
    assert pages.check_pages(broken).first()["violation"] == "record_invalid"
    good = pages.read_pages(spark, str(tmp_path), "customers")
    counters = normalize.ingest_counters(good, normalize.normalize_customers(pages.page_records(good)), "external_id").first()
    assert (counters["total_reported"], counters["accepted"], counters["rejected"], counters["duplicates"]) == (3, 1, 2, 1)
    assert counters["balanced"] and pages.check_scan(good).first()["repeated_in_page"] == 1


def test_sinks_and_external_view(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "name string, n long")
    with pytest.raises(ValueError, match="not a count"):
        sinks.write_summary(df, str(tmp_path / "a"))
    assert tables.external_view(df, ["n"]).columns == ["n"]
    with pytest.raises(ValueError, match="outside"):
        tables.external_view(df, ["n"], {"secret": F.col("name")})
    report = spark.createDataFrame([(1, dt.date(2026, 9, 30), 5)], "partner_id long, period_end date, case_id long")
    for version in (1, 2):
        sinks.write_report_version(report, str(tmp_path / "r"), version)
    sinks.write_report_version(report, str(tmp_path / "r"), 2)
    other = report.withColumn("partner_id", F.lit(2).cast("bigint"))
    sinks.write_report_version(other, str(tmp_path / "r"), 1)
    sinks.write_report_version(other.withColumn("case_id", F.lit(6).cast("bigint")), str(tmp_path / "r"), 1)
    found = sinks.read_reports(spark, str(tmp_path / "r")).select("partner_id", "version", "case_id").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 5), (1, 2, 5), (2, 1, 6)]


def test_commits_of_two_writers(spark, tmp_path):
    """Both begin before either commits: numbers tell the winner, a careful writer is told, readers keep their snapshot."""
    path = str(tmp_path / "r")
    report = spark.createDataFrame([(1, dt.date(2026, 9, 30), 5), (2, dt.date(2026, 9, 30), 6)], "partner_id long, period_end date, case_id long")
    assert sinks.write_report_version(report, path, 1) == 1

    def changed(by):
        return report.filter("partner_id = 1").withColumn("case_id", F.col("case_id") + by)

    def shown(frame):
        return sorted((r.partner_id, r.case_id) for r in frame.collect())

    base = sinks.last_commit(spark, path)
    one, two, three = (sinks.stage_slices(changed(by), path, 1) for by in (10, 20, 30))
    before = sinks.read_reports(spark, path)
    assert sinks.commit_slices(spark, path, two, base) == 2
    with pytest.raises(sinks.SliceConflict):
        sinks.commit_slices(spark, path, three, base, on_conflict="fail")
    assert shown(before) == [(1, 5), (2, 6)] and shown(sinks.read_reports(spark, path)) == [(1, 25), (2, 6)]
    assert sinks.commit_slices(spark, path, one, base) == 3
    assert shown(sinks.read_reports(spark, path)) == [(1, 15), (2, 6)]
    assert shown(sinks.read_reports(spark, path, as_of=2)) == [(1, 25), (2, 6)] and shown(before) == [(1, 5), (2, 6)]
    # A writer of other slices doesn't mind.
    other = sinks.stage_slices(report.filter("partner_id = 2"), path, 2)
    assert sinks.commit_slices(spark, path, other, base, on_conflict="fail") == 4
    assert sinks._put_if_absent(spark, f"{path}/commits/{4:020}.json", "{}") is False
    assert sinks.last_commit(spark, path) == 4


def test_iso_forms(spark):
    day = dt.datetime(2024, 1, 1, 10, 0)
    forms = {
        "2024-01-01T10:00:00.1234567Z": day.replace(microsecond=123456), "2024-01-01T10": day + dt.timedelta(hours=3),
        "20240101T101010": dt.datetime(2024, 1, 1, 13, 10, 10), "20240101T101010Z": dt.datetime(2024, 1, 1, 10, 10, 10),
        "2024-01-01 10:00+02": day - dt.timedelta(hours=2), "20240101": dt.datetime(2024, 1, 1, 3), "2024-01-01T1010-0300": dt.datetime(2024, 1, 1, 13, 10),
        "2024-01-01T10:00:00,5Z": day.replace(microsecond=500000), "2024-13-01T10": None, "2024-01-01T": None, "20240101T1": None, "2024": None,
    }
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    found = {r["t"]: r["m"] for r in df.select("t", s.iso_timestamp_text(F.col("t")).alias("m")).collect()}
    assert found == forms


def test_movement_age_counts_from_its_own_day(spark, rows):
    late = dt.datetime(2024, 1, 21, 2, 30)  # half past eleven the evening before, three hours behind
    movements = spark.createDataFrame([(1, late, dt.date(2024, 1, 20))], "case_id long, occurred_at timestamp, occurred_on date")
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    assert rows(coverage.movement_age(cases, movements, "2024-01-20")) == [("0_30_days", 1), ("without_movement", 1)]


def test_synthetic_portfolio_sizes(spark):
    wanted = spark.createDataFrame([(1, "zero"), (2, "one"), (3, "many")], "partner_id long, scenario string")
    counts = {
        r["partner_id"]: (r["c"], r["p"])
        for r in synthetic.synthetic_cases(wanted).groupBy("partner_id").agg(
            F.count_distinct("case_id").alias("c"), F.count_distinct("customer_id").alias("p")
        ).collect()
    }
    assert counts == {2: (1, 1), 3: (55, 30)}


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("CPF 123.456.789-09", "cpf"), ("CNPJ 12.345.678/0001-90", "cnpj"), ("1234567-89.2026.1.01.0001", "case_number"),
        ("senha: synthetic-secret", "credential_word"), ("Bearer synthetic-token", "credential_word"),
        ("diagnóstico sintético", "health_word"), ("<script>alert(1)</script>", "active_html"), ("<img src=x onerror=alert(1)>", "active_html"),
        ("sk-abcdefghijkl", "api_key"),
    ],
)
def test_sensitive_patterns(spark, text, code):
    df = spark.createDataFrame([(text, "plain"), ("nothing here", None)], "a string, b string")
    found = [r["findings"] for r in profile.scan_sensitive(df, ["a", "b"]).collect()]
    assert code in found[0] and found[1] == []
    assert [r["side"] for r in profile.quarantine(df, ["a", "b"]).collect()] == ["quarantine", "clean"]


def test_schema_profile_counts_every_element(spark):
    late = '{"a":[' + ",".join(["1"] * 20) + ',"x","y"],"b":null,"c":{"partner_id":1.5,"n":12345678901234567890}}'
    df = spark.createDataFrame([(late,), ("not json",), ('{"a":[',), ("[]",), ("7",), (None,)], "j string")
    found = profile.field_roles(profile.schema_profile(df, "j")).orderBy("path").collect()
    assert [(r["path"], r["types"], r["observed"], r["nulls"]) for r in found] == [
        ("", ["malformed"], 2, 0), ("a", ["array"], 1, 0), ("a[]", ["integer", "string"], 22, 0), ("b", ["null"], 1, 1),
        ("c", ["object"], 1, 0), ("c.n", ["integer"], 1, 0), ("c.partner_id", ["number"], 1, 0),
    ]
    assert found[6]["is_id"] and found[6]["is_partner_candidate"] and found[3]["has_nulls"]


def test_direct_partner_at_any_depth(spark):
    texts = {
        '{"a":[1,2,{"b":[{"Partner-ID":3}]}]}': True, '{"Parceiro":{"x":1,"id":null}}': True, '{"partner":[{"id":1}]}': False,
        '{"partner":"partner_id"}': False, '{"partner":{"ids":1}}': False, '{"x":"{\\"partner_id\\":1}"}': False, "partner": False,
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "j string")
    found = {r["j"]: r["direct"] for r in profile.with_direct_partner(df, "j").collect()}
    assert found == texts | {None: False}


def test_nested_texts_and_keys_are_scanned(spark):
    df = spark.createDataFrame(
        [([("x", {"password": 1})],), ([("123.456.789-09", {"k": 1})],), ([("fine", None), ("<", {"script": 2})],), (None,)],
        "a array<struct<t string, m map<string,int>>>",
    )
    assert [r["findings"] for r in profile.scan_sensitive(df, ["a"]).collect()] == [["credential_word"], ["cpf"], [], []]


def test_edges_of_very_long_texts(spark):
    n = 10**6
    texts = ["a" + " " * n + "b", " " * n, " \u2003\t" * (n // 4) + "x\n", " a \n", "", "\x1f\u00a0 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    start = time.time()
    found = [r["t"] for r in df.select("i", s.edge_trim(F.col("t")).alias("t")).orderBy("i").collect()]
    assert time.time() - start < 30
    assert found[:5] == [texts[0], "", "x", "a", ""]


def test_a_text_of_several_columns_is_opened_once(spark, rows):
    texts = [('{"a": 1, "b": [null, "x"]}', '{"a": 1, "b": [null, "x"]}'), ('{"a": 2.5}', '{"a": '), (None, "7")]
    df = spark.createDataFrame(texts, "first string, second string")
    found = rows(profile.schema_profiles(df, "first", "second"), "column", "path", "types", "observed", "nulls")
    apart = [(c, *r) for c in df.columns for r in rows(profile.schema_profile(df, c), "path", "types", "observed", "nulls")]
    assert found == sorted(apart, key=repr)
    plan = profile.schema_profiles(df, "first", "second")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    profiles = profile.schema_profiles(df, "first", "second").withColumn("resource", F.lit("lawsuits"))
    assert rows(profile.linkage_conclusion(profiles, "column"), "column", "conclusion") == [
        ("first", "INCONCLUSIVO"), ("second", "INCONCLUSIVO"),
    ]
