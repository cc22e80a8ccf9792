import datetime as dt

from folioscope.operators import links, spread

LINK = "link_id long, partner_id long, entity_type string, entity_id long, valid_from date, valid_to date, status string"
DAY = dt.date(2026, 9, 21)
START = dt.date(2026, 1, 1)


def _frames(spark):
    customers = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    cases = spark.createDataFrame([(10,), (11,), (12,)], "case_id long")
    bridge = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "case_id long, customer_id long")
    return customers, cases, bridge


def test_linkage_counts(spark, rows):
    customers, cases, bridge = _frames(spark)
    mappings = spark.createDataFrame(
        [
            (1, 7, "customer", 1, START, None, "active"),
            (2, 8, "customer", 2, START, None, "active"),
            (3, 9, "case", 99, START, dt.date(2026, 2, 1), "inactive"),
        ],
        LINK,
    )
    found = rows(links.validate_linkage(customers, bridge, cases, mappings, DAY))
    assert found == [("case", 3, 1, 1, 1, 1), ("customer", 3, 2, 1, 0, 0)]


def test_validity_is_closed_and_status_counts(spark, rows):
    mappings = spark.createDataFrame(
        [
            (1, 7, "customer", 1, START, DAY, "active"),
            (2, 7, "customer", 1, START, DAY - dt.timedelta(1), "active"),
            (3, 7, "customer", 1, DAY, None, "active"),
            (4, 7, "customer", 1, DAY + dt.timedelta(1), None, "active"),
            (5, 7, "customer", 1, START, None, "pending"),
        ],
        LINK,
    )
    assert rows(links.effective_on(mappings, DAY), "link_id") == [(1,), (3,)]


def test_overlaps_include_equal_days_and_touching_ends(spark, rows):
    day = [START + dt.timedelta(n) for n in range(10)]
    data = [
        (1, 7, "case", 1, day[0], day[3], "active"),
        (2, 8, "case", 1, day[3], day[4], "active"),
        (3, 8, "case", 1, day[5], None, "active"),
        (4, 9, "case", 1, day[9], None, "active"),
        (5, 9, "case", 1, day[9], None, "inactive"),
        (6, 9, "case", 2, day[1], day[1], "active"),
        (7, 9, "case", 2, day[1], day[1], "active"),
    ]
    assert rows(links.overlapping_links(spark.createDataFrame(data, LINK)), "link_id") == [(2,), (4,), (7,)]


def test_gate_and_alerts(spark, rows):
    quality = spark.createDataFrame(
        [(1, 5, 0, 2, 0, 0), (2, 5, 1, 0, 3, 0), (3, 5, 0, 0, 0, 1)],
        "partner_id long, eligible_cases long, ambiguous_cases long, missing_movements long, "
        "missing_customer_references long, nonexistent_links long",
    )
    from pyspark.sql import functions as F

    from folioscope.functions.availability import is_consistent

    gate = links.technical_gate(quality, F.lit(True), F.lit(True))
    wrapped = links.apply_gate(gate, {"eligible_cases": "mapping"}, F.lit("2026-09-21").cast("timestamp"))
    shown = wrapped.select("partner_id", "eligible_cases.status", "eligible_cases.value", is_consistent(F.col("eligible_cases")))
    assert rows(shown) == [
        (1, "available", 5, True), (2, "pending_validation", None, True), (3, "pending_validation", None, True),
    ]
    alerts = rows(links.preview_alerts(quality))
    assert ("1", "missing_movement", "2") in {tuple(map(str, a)) for a in alerts} and len(alerts) == 5


def test_positions_cut_a_hot_group_into_slices(spark):
    """One key holds nearly all rows; ids spread over three digits of the id space."""
    ids = [n for n in range(300)] + [(1 << 21) + n for n in range(300)] + [(5 << 42) + n * 7 for n in range(300)]
    df = spark.createDataFrame([("hot", i % 3, i) for i in ids] + [("cold", 0, 5), (None, 0, 6)], "k string, d int, id long")
    found = spread.positions(df, ["k"], "id", "pos", [("d",)]).collect()
    hot = [(r["d"], r["id"]) for r in sorted((r for r in found if r["k"] == "hot"), key=lambda r: r["pos"])]
    assert hot == sorted((i % 3, i) for i in ids)
    assert sorted(r["pos"] for r in found if r["k"] == "hot") == list(range(1, 901))
    assert [r["pos"] for r in found if r["k"] != "hot"] == [1, 1]


def test_references_grow_beyond_three_digits(spark):
    df = spark.range(1200).selectExpr("1 as partner_id", "id as case_id")
    refs = {r["case_id"]: r["reference"] for r in links.anonymous_refs(df, "partner_id", "case_id", "L").collect()}
    assert refs[0] == "L-001" and refs[998] == "L-999" and refs[1199] == "L-1200"


def test_digest_ignores_order_and_sees_changes(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    two = spark.createDataFrame([(2, None), (1, "a")], "id long, t string")
    other = spark.createDataFrame([(1, "a"), (2, "")], "id long, t string")
    more = one.unionByName(one.limit(1))
    digests = [spread.multiset_digest(df, ["id", "t"]).first()["digest"] for df in (one, two, other, more)]
    assert digests[0] == digests[1] and len(set(digests)) == 3
