"""Reconciliation and import-review queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import blocks, hash_tree, reconcile
from folioscope.operators.spread import digest_words, finished_digest
from folioscope.plans.registry import query
from folioscope.session import work_folder

_ITEM_SHAPE = "item_id l, status s, method s, matched_id n, reason_code s"


def reconcile_sql(scope: str) -> str:
    """The cascade in SQL; ``scope`` is the extra grouping of the repeat check."""
    by_scope = f"{scope}, " if scope else ""
    pattern = r"^[0-9]{7}[-.]?[0-9]{2}[.]?[0-9]{4}[.]?[0-9][.]?[0-9]{2}[.]?[0-9]{4}$"
    number = f"CASE WHEN regexp_matches(trim(process_number), '{pattern}') THEN regexp_replace(process_number, '[^0-9]', '', 'g') END"
    return rf"""WITH cand AS (SELECT external_id, {number} AS number, nullif(nfc_normalize(trim(folder)), '') AS folder FROM candidates),
      man AS (SELECT item_id, doc_id, quality_flags, process_number <> '' AS has_number, {number} AS number,
        nullif(nfc_normalize(trim(folder)), '') AS folder FROM manifest),
      keyed AS (SELECT *, coalesce(has_number, FALSE) AS by_number,
        CASE WHEN coalesce(has_number, FALSE) THEN number ELSE folder END AS key FROM man),
      counted AS (SELECT *, CASE WHEN key IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY {by_scope}by_number, key) END AS copies
        FROM keyed),
      idx AS (SELECT TRUE AS by_number, number AS key, count(*) AS n, min(external_id) AS target, min(folder) AS target_folder
        FROM cand WHERE number IS NOT NULL GROUP BY number
        UNION ALL SELECT FALSE, folder, count(*), min(external_id), min(folder) FROM cand WHERE folder IS NOT NULL GROUP BY folder),
      outcome AS (SELECT c.*, i.target, CASE
          WHEN list_contains(quality_flags, 'duplicate_source') OR copies > 1 THEN 'duplicate_source'
          WHEN list_has_any(quality_flags, ['invalid_identifier', 'missing_identifier', 'incomplete_block']) THEN 'invalid_identifier'
          WHEN c.key IS NULL THEN 'invalid_identifier' WHEN i.n IS NULL THEN 'no_exact_candidate'
          WHEN i.n > 1 THEN 'multiple_exact_candidates'
          WHEN c.by_number AND c.folder <> i.target_folder THEN 'number_folder_conflict' END AS reason
        FROM counted c LEFT JOIN idx i ON i.by_number = c.by_number AND i.key = c.key),
      doubled AS (SELECT *, reason IS NULL AND count(*) OVER (PARTITION BY {by_scope}reason IS NULL, target) > 1 AS twice FROM outcome)
      SELECT item_id, doc_id, CASE WHEN twice THEN 'duplicate_source' WHEN reason IS NULL THEN 'matched'
          WHEN reason = 'no_exact_candidate' THEN 'unmatched'
          WHEN reason IN ('multiple_exact_candidates', 'number_folder_conflict') THEN 'ambiguous' ELSE reason END AS status,
        CASE WHEN reason IS NULL AND NOT twice THEN CASE WHEN by_number THEN 'process_number_exact' ELSE 'folder_exact_unique' END END AS method,
        CASE WHEN reason IS NULL AND NOT twice THEN target END AS matched_id,
        CASE WHEN twice THEN 'duplicate_target' ELSE reason END AS reason_code FROM doubled"""


_COUNTS = """count(*) AS total, count_if(status = 'matched') AS matched, count_if(status = 'unmatched') AS unmatched,
       count_if(status = 'ambiguous') AS ambiguous, count_if(status = 'duplicate_source') AS duplicate_source,
       count_if(status = 'invalid_identifier') AS invalid_identifier"""
_COUNT_SHAPE = "total l, matched l, unmatched l, ambiguous l, duplicate_source l, invalid_identifier l"


@query("r1_reconcile", _ITEM_SHAPE, reconcile_sql(""))
def r1(m):
    return reconcile.reconcile(m.manifest(), m.candidates())


@query("r1_reconcile_per_document", _ITEM_SHAPE, reconcile_sql("doc_id"))
def r1_scoped(m):
    return reconcile.reconcile(m.manifest(), m.candidates(), ["doc_id"])


@query("r2_summarize", _COUNT_SHAPE, f"SELECT {_COUNTS} FROM ({reconcile_sql('')})")
def r2(m):
    return reconcile.summarize_status(reconcile.reconcile(m.manifest(), m.candidates()))


_WORDS = ", ".join(f"sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT)" for i in range(4))


def digest_sql(rows: str, columns: str, by: str = "") -> str:
    """SQL of the multiset digest over ``rows``."""
    group = f"{by}, " if by else ""
    return f"""SELECT {group}count(*) AS rows, sha256(concat_ws(':', count(*), {_WORDS})) AS digest
        FROM (SELECT *, sha256(concat_ws(chr(31), {columns})) AS h FROM ({rows})) {"GROUP BY " + by if by else ""}"""


_CAND_ROWS = "SELECT external_id, process_number AS number, nullif(trim(folder), '') AS folder_norm, record_digest, customer_id FROM candidates"
_CAND_COLUMNS = ", ".join(
    f"coalesce({c}::VARCHAR, chr(0))" for c in ("external_id", "number", "folder_norm", "record_digest", "customer_id")
)


@query("r3_snapshot_digest", "customer_id l, rows l, digest s", digest_sql(_CAND_ROWS, _CAND_COLUMNS, "customer_id"))
def r3(m):
    """One digest per customer's share of the snapshot."""
    return reconcile.snapshot_digest(m.candidates(), ["customer_id"]).withColumnRenamed("snapshot_sha256", "digest")


_SECOND_READS = {
    "same": "SELECT * FROM candidates",
    "shortened": "SELECT * FROM candidates WHERE folder IS NOT NULL",
    "doubled": "SELECT * FROM candidates UNION ALL SELECT * FROM candidates WHERE external_id % 4 = 1",
    "changed": "SELECT * REPLACE (CASE WHEN external_id % 8 = 1 THEN customer_id + 1 ELSE customer_id END AS customer_id) FROM candidates",
}


def _second_reads(m) -> dict:
    first = m.candidates()
    moved = F.when(F.col("external_id") % 8 == 1, F.col("customer_id") + 1).otherwise(F.col("customer_id"))
    return {
        "same": first,
        "shortened": first.filter("folder is not null"),
        "doubled": first.unionByName(first.filter("external_id % 4 = 1")),
        "changed": first.withColumn("customer_id", moved),
    }


def _integrity_sql(name: str, rows: str) -> str:
    read = _CAND_ROWS.replace("FROM candidates", f"FROM ({rows})")
    return f"""SELECT '{name}' AS read, (SELECT count(*) FROM ({rows})) = (SELECT count(*) FROM candidates) AS total_ok,
        (SELECT count(*) = count(DISTINCT external_id) FROM ({rows})) AS ids_unique,
        (SELECT digest FROM ({digest_sql(read, _CAND_COLUMNS)})) = (SELECT digest FROM ({digest_sql(_CAND_ROWS, _CAND_COLUMNS)})) AS digest_ok"""


@query(
    "r3_snapshot_integrity",
    "read s, total_ok b, ids_unique b, digest_ok b",
    " UNION ALL ".join(_integrity_sql(name, rows) for name, rows in _SECOND_READS.items()),
)
def r3_integrity(m):
    """Four reads against the total and digest that the first one stated."""
    stated = reconcile.snapshot_digest(m.candidates()).first()
    parts = [
        reconcile.snapshot_integrity(read, stated["rows"], stated["snapshot_sha256"]).withColumn("read", F.lit(name))
        for name, read in _second_reads(m).items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "r4_differing_keys",
    "read s, external_id l, difference s",
    """SELECT 'shortened' AS read, external_id, 'removed' AS difference FROM candidates WHERE folder IS NULL
       UNION ALL SELECT 'doubled', external_id, 'changed' FROM candidates WHERE external_id % 4 = 1
       UNION ALL SELECT 'changed', external_id, 'changed' FROM candidates WHERE external_id % 8 = 1
       UNION ALL SELECT 'longer', external_id, 'added' FROM candidates WHERE folder IS NULL""",
)
def r4_keys(m):
    """Which candidates differ between a stored read and later ones, and between a short read and the whole."""
    folder = work_folder(m.spark, "snapshots")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.candidates().schema)
    key = ["external_id"]
    bits = hash_tree.bits_for(m.candidates().count())
    for name, read in _second_reads(m).items():
        hash_tree.write_snapshot(read, key, f"{folder}/{name}", bits)
    pairs = {name: ("same", name) for name in ("shortened", "doubled", "changed")} | {"longer": ("shortened", "same"), "equal": ("same", "same")}
    parts = [
        hash_tree.differing_keys(m.spark, f"{folder}/{one}", f"{folder}/{two}", schema, key, bits).withColumn("read", F.lit(name))
        for name, (one, two) in pairs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "i10_moved_digest",
    "customer_id l, rows l, digest s",
    digest_sql(
        _CAND_ROWS.replace("FROM candidates", "FROM (SELECT * REPLACE (CASE WHEN external_id % 8 = 1 THEN customer_id + 1 ELSE customer_id END AS customer_id) "
        "FROM candidates WHERE folder IS NOT NULL OR external_id % 8 = 1)"),
        _CAND_COLUMNS,
        "customer_id",
    ),
)
def i10_moved(m):
    """Digests per customer after rows were removed and changed, from the digests before and those rows alone."""
    columns, by = ["external_id", "number", "folder_norm", "record_digest", "customer_id"], ["customer_id"]
    before = reconcile.with_keys(m.candidates())
    moved = F.col("external_id") % 8 == 1
    gone = before.filter(moved | F.col("folder").isNull())
    came = before.filter(moved).withColumn("customer_id", F.col("customer_id") + 1)
    after = hash_tree.moved_digest(digest_words(before, columns, by), gone, came, columns, by)
    return finished_digest(after)


@query(
    "r4_snapshots_agree",
    "read s, first_rows l, second_rows l, agree b",
    """WITH second AS (SELECT * FROM candidates WHERE folder IS NOT NULL),
       hit AS (SELECT c.* FROM candidates c WHERE process_number IN (SELECT '' || lpad(item_id::VARCHAR, 20, '0') FROM manifest
           JOIN orders ON o_orderkey = item_id WHERE o_orderstatus = 'F'))
       SELECT 'all' AS read, (SELECT count(*) FROM candidates) AS first_rows, (SELECT count(*) FROM second) AS second_rows, FALSE AS agree
       UNION ALL SELECT 'same', (SELECT count(*) FROM candidates), (SELECT count(*) FROM candidates), TRUE
       UNION ALL SELECT 'relevant', count(*), count(folder), count(*) = count(folder) FROM hit""",
)
def r4(m):
    """Two equal reads, a shortened second read, and the shortened one under the numbers of closed items only."""
    first = m.candidates()
    second = first.filter("folder is not null")
    numbered = m.manifest().join(
        m.stored("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id")), "item_id", "left_semi"
    )
    keys = reconcile.relevant_keys(numbered).filter("kind = 'number'")
    parts = [
        reconcile.snapshots_agree(first, second).withColumn("read", F.lit("all")),
        reconcile.snapshots_agree(first, first).withColumn("read", F.lit("same")),
        reconcile.snapshots_agree(first, second, keys).withColumn("read", F.lit("relevant")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "r5_proposals",
    "item_id s, status s, method s, matched_id n, evidence s, proposed_from d, proposed_to d",
    """SELECT item_id, status, method, matched_id, CASE WHEN status = 'matched' THEN
         sha256(concat_ws(':', batch_id, parser_version, 'snap', item_id, matched_id, method)) END AS evidence,
         CASE WHEN status = 'matched' THEN period_start END AS proposed_from,
         CASE WHEN status = 'matched' THEN period_end END AS proposed_to FROM items JOIN batches USING (batch_id)""",
)
def r5(m):
    return reconcile.proposals(m.items(deal=True), m.batches(), "snap")


@query(
    "r6_manifest_complete",
    "batch_id l, rows l, parsed_item_count l, complete b",
    """SELECT batch_id, coalesce(n, 0) AS rows, parsed_item_count, coalesce(n, 0) = parsed_item_count AND
         (n IS NULL OR (lo = 1 AND hi = n AND d = n)) AS complete FROM batches LEFT JOIN (SELECT batch_id, count(*) AS n,
         min(ordinal) AS lo, max(ordinal) AS hi, count(DISTINCT ordinal) AS d FROM items GROUP BY 1) USING (batch_id)""",
)
def r6(m):
    return reconcile.manifest_complete(m.items(deal=True), m.batches())


@query(
    "r7_flag_manifest",
    "item_id l, flags s",
    """SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(quality_flags,
         CASE WHEN key IS NOT NULL AND rn > 1 THEN ['duplicate_source'] ELSE [] END,
         CASE WHEN page_end > page_start THEN ['page_continuation'] ELSE [] END))), ',') AS flags
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number IS NULL, key ORDER BY ordinal) AS rn FROM (
         SELECT o_orderkey AS item_id, o_custkey AS doc_id, o_orderkey AS ordinal, 1 AS page_start, 1 + o_orderkey % 2 AS page_end,
           CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS number,
           coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS key,
           quality_flags FROM orders JOIN manifest ON item_id = o_orderkey))""",
)
def r7(m):
    items = m.stored("orders").selectExpr(
        "o_orderkey as item_id",
        "o_custkey as doc_id",
        "o_orderkey as ordinal",
        "cast(1 as bigint) as page_start",
        "1 + o_orderkey % 2 as page_end",
        "if(o_orderstatus = 'F', o_orderpriority, null) as number",
        "if(o_orderstatus = 'O', o_orderpriority, null) as folder",
    )
    flagged = items.join(m.manifest().select("item_id", "quality_flags"), "item_id")
    return reconcile.flag_manifest(flagged).withColumn("flags", F.array_join("quality_flags", ","))


_CHUNKS_SQL = r"""SELECT o_custkey AS doc_id, 1 + o_orderkey % 5 AS page, 2.0::DOUBLE AS x, 123.0::DOUBLE + 250 * ((o_orderkey // 5) % 6) AS y,
         CASE o_orderstatus WHEN 'F' THEN 'Processo ' || regexp_replace(lpad(o_orderkey::VARCHAR, 20, '0'),
           '^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$', '\1-\2.\3.\4.\5.\6')
           WHEN 'O' THEN 'processo 123' ELSE ' Processo' END AS text, o_orderkey * 8 AS chunk_id FROM orders
       UNION ALL SELECT o_custkey, 1 + o_orderkey % 5, 93.0, 179.0 + 250 * ((o_orderkey // 5) % 6), 'Pasta', o_orderkey * 8 + 1
         FROM orders WHERE o_orderpriority <> '5-LOW'
       UNION ALL SELECT o_custkey, 1 + o_orderkey % 5, 136.0, 179.0 + 250 * ((o_orderkey // 5) % 6)
         + CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'com espaço' ELSE ' F/' || o_orderkey END, o_orderkey * 8 + 2 FROM orders
       UNION ALL SELECT o_custkey, 6 + o_orderkey % 3, 100.0, 300.0, 'continuação', o_orderkey * 8 + 3 FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_custkey, 1, 2.0, 20.0, 'Relatório', o_orderkey * 8 + 4 FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_custkey, 1 + o_orderkey % 5, 140.0, 180.0 + 250 * ((o_orderkey // 5) % 6), '   ', o_orderkey * 8 + 5
         FROM orders WHERE o_orderpriority = '2-HIGH'"""


def _chunks(m):
    """Page text built from orders: one block per order in its customer's document."""
    page, y0 = "1 + o_orderkey % 5", "250 * ((o_orderkey div 5) % 6)"
    number = (
        "regexp_replace(lpad(cast(o_orderkey as string), 20, '0'), "
        "'^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$', '$1-$2.$3.$4.$5.$6')"
    )
    fields = "page bigint, x double, y double, text string, chunk_id bigint"
    names = [f.split()[0] for f in fields.split(", ")]

    def chunk(condition, page_, x, y, text, n):
        values = ", ".join(
            f"cast({v} as {f.split()[1]})" for v, f in zip((page_, x, y, text, f"o_orderkey * 8 + {n}"), fields.split(", "))
        )
        return f"if({condition}, struct({values}), null)"

    blocks_of_order = ", ".join(
        [
            chunk("true", page, 2, f"123 + {y0}",
                  f"case o_orderstatus when 'F' then concat('Processo ', {number}) when 'O' then 'processo 123' else ' Processo' end", 0),
            chunk("o_orderpriority <> '5-LOW'", page, 93, f"179 + {y0}", "'Pasta'", 1),
            chunk("true", page, 136, f"179 + {y0} + if(o_orderpriority = '1-URGENT', 2, 0)",
                  "if(o_orderpriority = '4-NOT SPECIFIED', 'com espaço', concat(' F/', o_orderkey))", 2),
            chunk("o_orderstatus = 'O'", "6 + o_orderkey % 3", 100, 300, "'continuação'", 3),
            chunk("o_orderstatus = 'F'", 1, 2, 20, "'Relatório'", 4),
            chunk("o_orderpriority = '2-HIGH'", page, 140, f"180 + {y0}", "'   '", 5),
        ]
    )
    exploded = m.stored("orders").selectExpr(
        "o_custkey as doc_id", f"explode(array_compact(array({blocks_of_order}))) as c"
    )
    return exploded.select("doc_id", *[F.col(f"c.col{i + 1}").alias(n) for i, n in enumerate(names)])


@query(
    "r8_extract_blocks",
    "doc_id l, ordinal l, number s, folder s, page_start l, page_end l, flags s",
    rf"""WITH ch AS (SELECT * REPLACE (trim(text) AS text) FROM ({_CHUNKS_SQL}) WHERE trim(text) <> ''),
       anchors AS (SELECT * FROM ch WHERE regexp_matches(text, '(?i)^\s*Processo\b') AND abs(x - 2) <= 10),
       labels AS (SELECT * FROM ch WHERE regexp_matches(text, '(?i)^\s*Pasta\s*:?\s*$') AND abs(x - 93) <= 12),
       lab AS (SELECT a.chunk_id, count(l.chunk_id) AS n, min(l.y) AS ly, min(l.text) AS lt FROM anchors a LEFT JOIN labels l
         ON l.doc_id = a.doc_id AND l.page = a.page AND l.y - a.y BETWEEN 48 AND 65 GROUP BY 1),
       val AS (SELECT a.chunk_id, count(v.chunk_id) AS n, min(trim(v.text)) AS folder FROM anchors a JOIN lab USING (chunk_id)
         LEFT JOIN ch v ON v.doc_id = a.doc_id AND v.page = a.page AND v.x BETWEEN 122 AND 160 AND abs(v.y - lab.ly) <= 3
           AND v.text <> lab.lt WHERE lab.n = 1 GROUP BY 1),
       found AS (SELECT a.*, CASE WHEN v.n = 1 AND regexp_matches(v.folder, '^[\w./-]{{1,80}}$') THEN v.folder END AS folder,
         nullif(regexp_replace(regexp_extract(text, '(^|[^0-9])([0-9]{{7}}[-.]?[0-9]{{2}}[.]?[0-9]{{4}}[.]?[0-9][.]?[0-9]{{2}}[.]?[0-9]{{4}})([^0-9]|$)', 2),
           '[^0-9]', '', 'g'), '') AS number, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, chunk_id) AS ordinal
         FROM anchors a LEFT JOIN val v USING (chunk_id)),
       ends AS (SELECT f.chunk_id, coalesce(min(nx.page) - 1, max(lp.last)) AS page_end FROM found f
         JOIN (SELECT doc_id, max(page) AS last FROM ch GROUP BY 1) lp USING (doc_id)
         LEFT JOIN found nx ON nx.doc_id = f.doc_id AND nx.page > f.page
         WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.page = f.page AND o.ordinal > f.ordinal) GROUP BY 1)
       SELECT doc_id, ordinal, number, folder, page AS page_start, coalesce(page_end, page) AS page_end,
         concat_ws(',', CASE WHEN folder IS NULL THEN 'incomplete_block' END,
           CASE WHEN number IS NULL AND regexp_matches(text, '[0-9]') THEN 'invalid_identifier' END,
           CASE WHEN number IS NULL AND folder IS NULL THEN 'missing_identifier' END) AS flags
       FROM found LEFT JOIN ends USING (chunk_id)""",
)
def r8(m):
    return blocks.extract_blocks(_chunks(m)).withColumn("flags", F.array_join("quality_flags", ","))


@query(
    "r8_document_layout",
    "doc_id l, pages l, items l, layout s",
    rf"""SELECT doc_id, max(page) AS pages, count_if(regexp_matches(text, '(?i)^\s*Processo\b') AND abs(x - 2) <= 10) AS items,
         CASE WHEN count_if(text = 'Relatório') = 0 THEN 'LAYOUT_UNKNOWN' ELSE 'items' END AS layout FROM ({_CHUNKS_SQL}) GROUP BY 1""",
)
def r8_layout(m):
    return blocks.document_layout(_chunks(m))


@query(
    "r9_duplicate_documents",
    "doc_id l, first_doc_id l, content_sha256 s",
    """SELECT doc_id, first_doc_id, h AS content_sha256 FROM (SELECT doc_id, sha256(text) AS h,
         min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc_id FROM documents) WHERE doc_id > first_doc_id""",
)
def r9(m):
    return reconcile.duplicate_documents(m.stored("documents"), "doc_id", F.col("text"))


_LATEST_RUN = """(SELECT batch_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, run_id DESC)
         AS rn FROM runs) WHERE rn = 1)"""
_LATEST_CORRECTION = """(SELECT item_id, after_id, review_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id
         ORDER BY review_revision DESC, review_id DESC) AS rn FROM reviews WHERE decision = 'corrected') WHERE rn = 1)"""
RESOLVED_SQL = f"""SELECT batch_id, item_id, target_id, CASE WHEN status = 'matched' THEN method ELSE 'manual_existing_id' END AS link_method,
         CASE WHEN status = 'matched' THEN evidence ELSE sha256(concat_ws(':', batch_id, run_id, item_id, target_id, review_id)) END AS link_evidence,
         CASE WHEN state <> 'needs_review' THEN 'batch_state'
           WHEN len(list_filter(quality_flags, lambda f : f <> 'page_continuation')) > 0 THEN 'manifest_flag'
           WHEN status = 'matched' AND (evidence IS NULL OR method IS NULL) THEN 'evidence_missing'
           WHEN target_id IS NULL THEN 'unresolved' WHEN live IS NULL THEN 'target_inactive'
           WHEN count(*) OVER (PARTITION BY batch_id, target_id) > 1 THEN 'target_repeated' END AS block_reason
       FROM (SELECT i.*, b.state, c.review_id, CASE WHEN i.status = 'matched' THEN matched_id
           WHEN i.status IN ('unmatched', 'ambiguous') THEN after_id END AS target_id
         FROM items i JOIN {_LATEST_RUN} r ON r.batch_id = i.batch_id AND r.run_id = i.run_id
         JOIN batches b ON b.batch_id = i.batch_id LEFT JOIN {_LATEST_CORRECTION} c ON c.item_id = i.item_id)
       LEFT JOIN (SELECT case_id AS target_id, TRUE AS live FROM targets WHERE status = 'active') USING (target_id)"""


def _resolved(m):
    """The items of the latest run of each batch, resolved."""
    return reconcile.resolve_for_approval(m.items(), m.reviews(), m.targets(), m.run_ids(), m.batches())


@query("r10_resolve_for_approval", "batch_id l, item_id s, target_id n, link_method s, link_evidence s, block_reason s", RESOLVED_SQL)
def r10(m):
    return _resolved(m)


@query(
    "r10_approvable_batches",
    "batch_id l, items l, blocked l, approvable b",
    f"""SELECT batch_id, n AS items, blocked, blocked = 0 AND n = parsed_item_count AS approvable FROM batches JOIN
         (SELECT batch_id, count(*) AS n, count(block_reason) AS blocked FROM ({RESOLVED_SQL}) GROUP BY 1) USING (batch_id)""",
)
def r10_batches(m):
    return reconcile.approvable_batches(_resolved(m), m.batches())


_OLD_SQL = """(SELECT batch_id, best FROM (SELECT batch_id, first_value(batch_id) OVER (PARTITION BY partner_id, period_start,
         period_end ORDER BY created_at DESC, batch_id DESC) AS best FROM batches WHERE state = 'approved') WHERE batch_id <> best)"""


@query(
    "r11_replace_period",
    "kind s, id s, state s, superseded_by n",
    f"""SELECT 'batch' AS kind, batch_id::VARCHAR AS id, CASE WHEN best IS NOT NULL THEN 'superseded' ELSE state END AS state,
         best AS superseded_by FROM batches LEFT JOIN {_OLD_SQL} USING (batch_id)
       UNION ALL SELECT 'link', link_id, CASE WHEN best IS NOT NULL THEN 'inactive' ELSE status END, NULL
         FROM batch_links LEFT JOIN {_OLD_SQL} USING (batch_id)""",
)
def r11(m):
    parts = reconcile.replace_period(m.batches(), m.batch_links())
    batches = parts["batches"].select(
        F.lit("batch").alias("kind"), F.col("batch_id").cast("string").alias("id"), "state", "superseded_by"
    )
    links = parts["links"].select(
        F.lit("link").alias("kind"), F.col("link_id").alias("id"), F.col("status").alias("state"),
        F.lit(None).cast("bigint").alias("superseded_by"),
    )
    return batches.unionByName(links)


@query(
    "r12_fresh_runs",
    "rule s, run_id l",
    """SELECT 'fresh' AS rule, run_id FROM runs WHERE snapshot_verified_at BETWEEN TIMESTAMP '1998-01-01 00:10:00' - INTERVAL 30 MINUTE
         AND TIMESTAMP '1998-01-01 00:10:00'
       UNION ALL SELECT 'covers_period', run_id FROM runs JOIN batches USING (batch_id)
         WHERE timezone('America/Sao_Paulo', timezone('UTC', snapshot_verified_at))::DATE >= period_end""",
)
def r12(m):
    fresh = reconcile.fresh(m.runs(), "1998-01-01 00:10:00").select(F.lit("fresh").alias("rule"), "run_id")
    covering = reconcile.covers_period(m.runs(), m.batches()).select(F.lit("covers_period").alias("rule"), "run_id")
    return fresh.unionByName(covering)


@query(
    "r13_new_runs",
    "run_id l",
    """SELECT run_id FROM runs WHERE (batch_id, snapshot_sha256, parser_version) NOT IN
       (SELECT (batch_id, snapshot_sha256, parser_version) FROM runs WHERE result_total > 4)""",
)
def r13(m):
    return reconcile.new_runs(m.runs(), m.runs().filter("result_total > 4"))


@query(
    "r14_activate_links",
    "partner_id l, entity_id l, valid_from d, valid_to d, item_id s, match_method s, evidence s, reviewed_by l, reviewed_at t",
    f"""SELECT partner_id, target_id AS entity_id, period_start AS valid_from, period_end AS valid_to, item_id, link_method AS match_method,
         link_evidence AS evidence, 7 AS reviewed_by, TIMESTAMP '2024-01-20 00:00:00' AS reviewed_at
       FROM ({RESOLVED_SQL}) JOIN batches USING (batch_id) WHERE block_reason IS NULL""",
)
def r14(m):
    return reconcile.activate_links(_resolved(m), m.batches(), 7, "2024-01-20 00:00:00")


@query(
    "r15_relevant_keys",
    "kind s, key s",
    """SELECT DISTINCT 'number' AS kind, regexp_replace(process_number, '[^0-9]', '', 'g') AS key FROM manifest
         WHERE process_number IS NOT NULL AND process_number <> 'ABC'
       UNION SELECT 'folder', trim(folder) FROM manifest WHERE trim(folder) <> ''""",
)
def r15(m):
    return reconcile.relevant_keys(m.manifest())


@query(
    "r16_reconcile_corpus",
    f"doc_id l, {_COUNT_SHAPE}, exclusive b",
    f"""SELECT -1 AS doc_id, *, unmatched + ambiguous + duplicate_source = 0 AS exclusive FROM (SELECT {_COUNTS} FROM ({reconcile_sql('')}))
        UNION ALL SELECT doc_id, total, matched, unmatched, ambiguous, duplicate_source, invalid_identifier,
          unmatched + ambiguous + duplicate_source = 0 FROM (SELECT doc_id, {_COUNTS} FROM ({reconcile_sql('doc_id')}) GROUP BY 1)""",
)
def r16(m):
    parts = reconcile.reconcile_corpus(m.manifest(), m.candidates())
    clean = (F.col("unmatched") + F.col("ambiguous") + F.col("duplicate_source")) == 0
    corpus = parts["corpus"].withColumn("doc_id", F.lit(-1).cast("bigint"))
    return corpus.unionByName(parts["documents"].withColumn("exclusive", clean))


@query(
    "r17_pending_decisions",
    "item_id s, decision s, reason_code s",
    """SELECT item_id, 'returned' AS decision, 'INVALID_IDENTIFIER_ACCEPTED_PENDING' AS reason_code FROM items
       WHERE status = 'invalid_identifier' AND item_id NOT IN (SELECT item_id FROM reviews
         WHERE reason_code = 'INVALID_IDENTIFIER_ACCEPTED_PENDING')""",
)
def r17(m):
    return reconcile.pending_decisions(m.items(), m.reviews())


@query(
    "r18_parse_outcome",
    "doc_id l, items l, flagged l, next_state s",
    """SELECT d.doc_id, coalesce(n, 0) AS items, coalesce(flagged, 0) AS flagged,
         CASE WHEN n_chars <> length(text) OR source = 'src3' THEN 'rejected' WHEN coalesce(n, 0) = 0 OR blocking > 0 THEN 'needs_review'
           ELSE 'parsed' END AS next_state
       FROM documents d LEFT JOIN (SELECT batch_id AS doc_id, count(*) AS n, count_if(len(quality_flags) > 0) AS flagged,
         count_if(list_contains(quality_flags, 'missing_identifier')) AS blocking FROM items GROUP BY 1) USING (doc_id)""",
)
def r18(m):
    """Documents with the items of the order of the same number as their manifest."""
    documents = m.stored("documents").select(
        "doc_id",
        F.sha2("text", 256).alias("content_sha256"),
        F.when(F.col("source") == "src3", "other").otherwise(F.sha2("text", 256)).alias("stored_sha256"),
        F.length("text").cast("bigint").alias("pages"),
        F.col("n_chars").alias("stored_pages"),
    )
    return reconcile.parse_outcome(documents, m.items().withColumnRenamed("batch_id", "doc_id"))


@query(
    "r19_new_requests",
    "batch_id l, decision s",
    """SELECT v.batch_id, CASE WHEN EXISTS (SELECT 1 FROM versions o WHERE o.status = 'published' AND o.partner_id = v.partner_id
           AND o.batch_id = v.batch_id AND o.source_digest = v.source_digest) THEN 'done'
         WHEN EXISTS (SELECT 1 FROM requests r WHERE r.status IN ('pending', 'running') AND r.partner_id = v.partner_id
           AND r.batch_id = v.batch_id AND r.source_digest = v.source_digest) THEN 'already_active'
         WHEN v.partner_id IN (SELECT partner_id FROM requests WHERE status IN ('pending', 'running')) THEN 'conflict'
         ELSE 'queue' END AS decision FROM versions v""",
)
def r19(m):
    revisions = m.versions().select("partner_id", "batch_id", "source_digest")
    return reconcile.new_requests(revisions, m.versions().filter("status = 'published'"), m.requests())


@query(
    "r20_correctable",
    "item_id s, after_id l",
    f"""SELECT item_id, after_id FROM reviews JOIN items i USING (item_id) JOIN {_LATEST_RUN} r
         ON r.batch_id = i.batch_id AND r.run_id = i.run_id
       WHERE decision = 'corrected' AND i.status IN ('unmatched', 'ambiguous')
         AND after_id IN (SELECT case_id FROM targets WHERE status = 'active')""",
)
def r20(m):
    wanted = m.reviews().filter("decision = 'corrected'").select("item_id", "after_id")
    return reconcile.correctable(m.items(), m.run_ids(), m.targets(), wanted)
