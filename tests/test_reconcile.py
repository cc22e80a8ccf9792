from pyspark.sql import functions as F

from folioscope.operators import blocks, reconcile

MANIFEST = "item_id long, doc_id long, process_number string, folder string, quality_flags array<string>"
CANDIDATE = "external_id long, process_number string, folder string, record_digest string, customer_id long"
N1, N2, N3 = "12345678920261234567", "1234567-89.2026.1.23.4568", "12345678920261234569"


def _run(spark, items, candidates, scope=()):
    manifest = spark.createDataFrame([(i + 1, 1, *item) for i, item in enumerate(items)], MANIFEST)
    found = spark.createDataFrame([(i + 1, *c, "d", 1) for i, c in enumerate(candidates)], CANDIDATE)
    result = reconcile.reconcile(manifest, found, list(scope)).orderBy("item_id").collect()
    return [(r["status"], r["method"], r["matched_id"], r["reason_code"]) for r in result]


def test_cascade_without_folder_fallback(spark):
    got = _run(
        spark,
        [(N1, None, []), (None, " PASTA-02 ", []), (None, "Maria da Silva", []), (N3, "PASTA-02", [])],
        [("1234567-89.2026.1.23.4567", None), (None, "PASTA-02")],
    )
    assert got == [
        ("matched", "process_number_exact", 1, None),
        ("matched", "folder_exact_unique", 2, None),
        ("unmatched", None, None, "no_exact_candidate"),
        ("unmatched", None, None, "no_exact_candidate"),
    ]


def test_ambiguous_conflict_invalid_and_repeats(spark):
    got = _run(
        spark,
        [
            (N1, None, []),
            (N2, "PASTA-09", []),
            (None, "SHARED", []),
            (None, "X", ["incomplete_block"]),
            (None, "", []),
            ("123", "PASTA-02", []),
            (None, "REP", []),
            (None, "REP", []),
            (None, "FLAG", ["duplicate_source"]),
            (None, "OK", ["page_continuation"]),
        ],
        [(N1, None), (N1, None), (N2, "PASTA-01"), (None, "SHARED"), (None, "SHARED"), (None, "PASTA-02"), (None, "REP"), (None, "OK")],
    )
    assert [(s, r) for s, _, _, r in got] == [
        ("ambiguous", "multiple_exact_candidates"),
        ("ambiguous", "number_folder_conflict"),
        ("ambiguous", "multiple_exact_candidates"),
        ("invalid_identifier", "invalid_identifier"),
        ("invalid_identifier", "invalid_identifier"),
        ("invalid_identifier", "invalid_identifier"),
        ("duplicate_source", "duplicate_source"),
        ("duplicate_source", "duplicate_source"),
        ("duplicate_source", "duplicate_source"),
        ("matched", None),
    ]


def test_two_items_on_one_target_are_both_duplicates(spark):
    got = _run(spark, [(N1, None, []), (None, "PASTA-01", [])], [(N1, "PASTA-01")])
    assert got == [("duplicate_source", None, None, "duplicate_target")] * 2


def test_exactly_one_outcome_per_item_with_a_hot_key(spark):
    manifest = spark.range(3000).select(
        F.col("id").alias("item_id"),
        F.lit(1).cast("long").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit(N1)).alias("process_number"),
        F.when(F.col("id") % 3 == 1, F.concat(F.lit("F"), F.col("id"))).alias("folder"),
        F.array().cast("array<string>").alias("quality_flags"),
    )
    candidates = spark.range(3000).select(
        F.col("id").alias("external_id"),
        F.lit(N1).alias("process_number"),
        F.concat(F.lit("F"), F.col("id")).alias("folder"),
        F.lit("d").alias("record_digest"),
        F.lit(1).alias("customer_id"),
    )
    counts = reconcile.summarize_status(reconcile.reconcile(manifest, candidates)).first()
    assert (counts["total"], counts["duplicate_source"], counts["matched"], counts["invalid_identifier"]) == (3000, 1000, 1000, 1000)


def test_snapshots_may_differ_outside_the_relevant_keys(spark):
    base = spark.createDataFrame([(1, N1, None, "a", 1), (2, None, "F", "a", 1), (3, None, "G", "a", 1)], CANDIDATE)
    edited = base.withColumn("record_digest", F.when(F.col("external_id") == 3, "b").otherwise(F.col("record_digest")))
    manifest = spark.createDataFrame([(1, 1, N1, None, []), (2, 1, None, "F", [])], MANIFEST)
    keys = reconcile.relevant_keys(manifest)
    assert reconcile.snapshots_agree(base, base).first()["agree"]
    assert not reconcile.snapshots_agree(base, edited).first()["agree"]
    assert reconcile.snapshots_agree(base, edited, keys).first()["agree"]


CHUNK = "doc_id long, page long, x double, y double, text string, chunk_id long"


def _chunks(spark, items, pages=1):
    data = []
    for k, (number, folder) in enumerate(items):
        y = 250.0 * k
        data += [(2.0, 123 + y, f"Processo {number}"), (93.0, 179 + y, "Pasta"), (136.0, 179 + y, folder), (100.0, 300.0, "Contato")]
    rows = [(1, 1, x, float(y), t, i) for i, (x, y, t) in enumerate(data) if t]
    rows += [(1, p, 100.0, 300.0, "Continuacao", 1000 + p) for p in range(2, pages + 1)]
    return spark.createDataFrame(rows, CHUNK)


def test_one_item_over_many_pages(spark):
    items = blocks.extract_blocks(_chunks(spark, [("", "PASTA-01")], pages=55))
    items = items.collect()
    assert [(r["folder"], r["page_start"], r["page_end"]) for r in items] == [("PASTA-01", 1, 55)]


def test_items_are_numbered_and_flagged(spark):
    many = blocks.extract_blocks(_chunks(spark, [("", f"PASTA-{n:02d}") for n in range(8)])).collect()
    assert sorted((r["ordinal"], r["folder"]) for r in many) == [(n + 1, f"PASTA-{n:02d}") for n in range(8)]
    found = blocks.extract_blocks(_chunks(spark, [("", "PASTA-01"), ("", "PASTA-01"), ("", ""), ("12", "PASTA-02"), (N2, "PASTA-03")]))
    flagged = reconcile.flag_manifest(found.withColumn("item_id", F.col("ordinal"))).orderBy("ordinal").collect()
    assert [(r["number"], r["folder"], r["quality_flags"]) for r in flagged] == [
        (None, "PASTA-01", []),
        (None, "PASTA-01", ["duplicate_source"]),
        (None, None, ["incomplete_block", "missing_identifier"]),
        (None, "PASTA-02", ["invalid_identifier"]),
        ("12345678920261234568", "PASTA-03", []),
    ]


def test_chunks_are_computed_once(spark):
    """However many steps look at the chunks, what gives them runs once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    chunks = _chunks(spark, [("", "PASTA-01"), (N2, "PASTA-03")], pages=4)
    expected = blocks.extract_blocks(chunks).collect()
    assert blocks.extract_blocks(chunks.mapInArrow(counted, CHUNK)).collect() == expected
    assert seen.value == chunks.count()


def test_blank_chunks_say_nothing(spark):
    blank = [(1, 1, 140.0, 180.0, "  ", 50), (1, 1, 136.0, 181.0, "\t", 51)]
    chunks = _chunks(spark, [("", " PASTA-01 ")]).unionByName(spark.createDataFrame(blank, CHUNK))
    assert [(r["folder"], r["quality_flags"]) for r in blocks.extract_blocks(chunks).collect()] == [("PASTA-01", [])]


def test_items_of_an_approval_travel_once_by_their_target(spark):
    batches = spark.createDataFrame([(1, "needs_review"), (2, "approved")], "batch_id long, state string")
    runs = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (20, 2, 1)], "run_id long, batch_id long, created_at long")
    items = [("old", 1, 10, "matched", 5, "m", "e"), ("a", 1, 11, "matched", 5, "m", "e"), ("b", 1, 11, "unmatched", None, None, None),
             ("c", 1, 11, "matched", 6, "m", "e"), ("d", 1, 11, "matched", 7, "m", None), ("e", 1, 11, "ambiguous", None, None, None),
             ("f", 1, 11, "invalid_identifier", None, None, None), ("g", 1, 11, "matched", 8, "m", "e"), ("h", 2, 20, "matched", 8, "m", "e")]
    schema = "item_id string, batch_id long, run_id long, status string, matched_id long, method string, evidence string"
    items = spark.createDataFrame(items, schema).withColumn("quality_flags", F.array().cast("array<string>"))
    reviews = [("r1", "b", 1, "corrected", 4), ("r2", "b", 2, "corrected", 5), ("r3", "f", 1, "corrected", 8)]
    reviews = spark.createDataFrame(reviews, "review_id string, item_id string, review_revision long, decision string, after_id long")
    targets = spark.createDataFrame([(5, "active"), (6, "inactive"), (7, "active"), (8, "active")], "case_id long, status string")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = reconcile.resolve_for_approval(items, reviews, targets, runs, batches)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["item_id"]: (r["target_id"], r["block_reason"]) for r in found.collect()}
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") <= 12
    assert not any("hashpartitioning" in line and "run_id" in line for line in plan.splitlines())
    assert got == {
        "a": (5, "target_repeated"), "b": (5, "target_repeated"), "c": (6, "target_inactive"), "d": (7, "evidence_missing"),
        "e": (None, "unresolved"), "f": (None, "unresolved"), "g": (8, None), "h": (8, "batch_state"),
    }
