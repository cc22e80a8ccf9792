"""The model tables of ``sources/sample.py`` stated once more in plain SQL, for the SQL twins."""

_ITEM = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_HASH_ID = f"('0x' || substr(sha256({_ITEM} || '-' || CAST(l_extendedprice AS DECIMAL(18,2))), 1, 15))::BIGINT"
_MASK = (
    r"regexp_replace(lpad(o_orderkey::VARCHAR, 20, '0'), "
    r"'^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$', '\1-\2.\3.\4.\5.\6')"
)
_NO_FLAGS = "CAST([] AS VARCHAR[])"

TABLES = {
    "partners": """SELECT n_nationkey::BIGINT AS partner_id, 'P-' || n_nationkey AS code, n_name AS name,
        CAST(5 + (n_nationkey % 4) * 5 AS DECIMAL(5,2)) AS percentage,
        CASE WHEN n_regionkey = 4 THEN 'inactive' ELSE 'active' END AS status FROM nation""",
    "customers": """SELECT c_custkey AS customer_id, c_name AS name, 'DOC-' || c_custkey AS identification,
        CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS origin,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status FROM customer""",
    "cases": f"""SELECT o_orderkey AS case_id,
        CASE o_orderstatus WHEN 'F' THEN {_MASK}
          WHEN 'O' THEN ' ' || lpad(o_orderkey::VARCHAR, 20, '0') || ' '
          ELSE CASE WHEN o_orderpriority <> '5-LOW' THEN lpad(o_orderkey::VARCHAR, 19, '0') END END AS process_number,
        CASE WHEN o_orderpriority <> '5-LOW' THEN ' F/' || o_custkey || ' ' END AS folder,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Execução/Cobrança' WHEN '2-HIGH' THEN 'JUDICIAL'
          WHEN '3-MEDIUM' THEN ' recursal' WHEN '4-NOT SPECIFIED' THEN 'RH/FINANCEIRO' ELSE 'ETAPA NOVA' END AS step,
        CASE o_orderstatus WHEN 'F' THEN 'HONORÁRIOS QUITADOS' WHEN 'O' THEN 'Aguardando  pagamento dos honorários'
          ELSE 'RPV EMITIDO' END AS stage,
        'R' || (o_custkey % 50) AS responsible, o_orderpriority AS contingency,
        CAST(o_totalprice AS DECIMAL(18,2)) AS fees_expected, o_orderdate::DATE AS opened_on,
        CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'inactive' ELSE 'active' END AS status
        FROM orders""",
    "case_customers": """SELECT o_orderkey AS case_id, o_custkey AS customer_id FROM orders
        UNION SELECT o_orderkey, o_custkey + 17 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION SELECT o_orderkey, o_custkey + 1000000000 FROM orders WHERE o_orderpriority = '5-LOW'""",
    "links": """SELECT c_custkey AS link_id, c_nationkey::BIGINT AS partner_id, 'customer' AS entity_type,
        c_custkey AS entity_id, DATE '1994-01-01' + (c_custkey % 5)::INT * 500 AS valid_from,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN DATE '1994-01-01' + ((c_custkey % 5)::INT * 500 + 700) END AS valid_to,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
        FROM customer WHERE c_mktsegment <> 'BUILDING'
        UNION ALL SELECT 10000000000 + o_orderkey, o_orderkey % 25, 'case',
        CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1000000000 ELSE o_orderkey END, o_orderdate::DATE, NULL, 'active'
        FROM orders WHERE o_orderpriority = '3-MEDIUM'""",
    "transactions": f"""SELECT {_HASH_ID} AS entry_id,
        CASE WHEN l_discount = 0 THEN NULL WHEN l_quantity = 1 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS case_id,
        CASE WHEN l_tax <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
        CASE WHEN l_returnflag = 'R' THEN 'expense' ELSE 'income' END AS entry_type,
        CASE WHEN l_returnflag = 'R' THEN CASE l_linenumber % 3 WHEN 0 THEN 'Taxas  bancárias'
            WHEN 1 THEN 'HONORÁRIOS DE PARCEIROS' ELSE 'SALÁRIOS' END
          ELSE CASE l_linenumber % 4 WHEN 0 THEN 'RPVS' WHEN 1 THEN 'HONORÁRIOS INICIAIS'
            WHEN 2 THEN 'honorários  finais' ELSE 'REEMBOLSO' END END AS category,
        l_shipdate::DATE AS date_due, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE END AS date_payment
        FROM lineitem""",
    "movements": "SELECT event_id AS movement_id, user_id AS case_id, ts AS occurred_at, "
    "(ts + to_hours(CAST(user_id % 9 - 3 AS INTEGER)))::DATE AS occurred_on, event_type AS title FROM events",
    "manifest": f"""SELECT o_orderkey AS item_id, o_custkey AS doc_id, o_orderkey AS ordinal,
        CASE o_orderstatus WHEN 'F' THEN {_MASK}
          WHEN 'O' THEN lpad((CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey + 500000000 ELSE o_orderkey END)::VARCHAR, 20, '0')
          ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'ABC' END END AS process_number,
        CASE WHEN o_orderstatus = 'O' THEN NULL
          WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '2-HIGH' THEN 'F-X' END
          WHEN o_orderpriority = '2-HIGH' THEN ' F-' || (1000000000 + o_orderkey) || ' '
          WHEN o_orderpriority = '3-MEDIUM' THEN 'F-' || o_custkey
          WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' ' ELSE 'F-' || (1000000000 + o_orderkey) END AS folder,
        CASE WHEN o_totalprice < 5000 THEN ['incomplete_block'] WHEN o_totalprice < 10000 THEN ['page_continuation']
          WHEN o_totalprice < 12000 THEN ['duplicate_source'] ELSE {_NO_FLAGS} END AS quality_flags FROM orders""",
    "candidates": """SELECT o_orderkey AS external_id,
        CASE o_orderpriority WHEN '5-LOW' THEN NULL
          WHEN '4-NOT SPECIFIED' THEN lpad((o_orderkey - o_orderkey % 3)::VARCHAR, 20, '0')
          ELSE lpad(o_orderkey::VARCHAR, 20, '0') END AS process_number,
        CASE o_orderpriority WHEN '3-MEDIUM' THEN 'F-' || o_custkey WHEN '1-URGENT' THEN NULL
          ELSE 'F-' || (1000000000 + o_orderkey) END AS folder,
        sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS record_digest,
        o_custkey AS customer_id FROM orders""",
    "directory": """SELECT c_custkey AS partner_id,
        (CASE WHEN c_mktsegment = 'BUILDING' THEN 'SYNTHETIC-' ELSE 'P-' END) || c_custkey AS external_id, c_name AS name,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
        c_mktsegment IN ('MACHINERY', 'FURNITURE') AS pilot_enabled,
        CAST(c_acctbal / 100 AS DECIMAL(5,2)) AS percentage,
        CASE WHEN c_custkey % 23 = 0 THEN TIMESTAMP '1998-01-01' END AS deleted_at FROM customer""",
    "batches": """SELECT o_orderkey AS batch_id, o_custkey AS partner_id, o_custkey AS source_id,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'needs_review'
          ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'quarantined' WHEN '2-HIGH' THEN 'parsed'
            WHEN '3-MEDIUM' THEN 'rejected' WHEN '4-NOT SPECIFIED' THEN 'superseded' ELSE 'failed' END END AS state,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'running' WHEN '3-MEDIUM' THEN 'pending'
          ELSE 'succeeded' END AS processing_status,
        date_trunc('month', o_orderdate)::DATE AS period_start, last_day(o_orderdate) AS period_end,
        o_orderdate AS created_at, o_orderdate AS updated_at,
        CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderdate + INTERVAL 1 DAY END
          AS processing_finished_at,
        o_custkey % 20 AS uploaded_by, 'v1' AS parser_version,
        coalesce(n_items, 0) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS parsed_item_count
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "runs": """SELECT batch_id * 2 + attempt AS run_id, batch_id, created_at + to_hours(attempt) AS created_at,
        CASE WHEN processing_status = 'running' THEN 'v0' ELSE 'v1' END AS parser_version,
        parsed_item_count AS result_total, parsed_item_count - CASE WHEN attempt = 0 THEN 2 ELSE 0 END AS matched_count,
        parsed_item_count + batch_id % 3 - 1 AS snapshot_total,
        created_at + to_days((batch_id % 40)::INT) AS snapshot_verified_at, 'snap-' || (batch_id % 7) AS snapshot_sha256
        FROM batches, (SELECT unnest([0, 1]) AS attempt) WHERE attempt = 0 OR state = 'needs_review'""",
    "items": f"""SELECT CASE WHEN first THEN {_ITEM} || '/first' ELSE {_ITEM} END AS item_id, l_orderkey AS batch_id, run_id,
        l_linenumber::BIGINT AS ordinal,
        CASE WHEN first THEN 'unmatched' WHEN l_returnflag IN ('N', 'A') THEN 'matched' WHEN l_linestatus = 'F' THEN 'ambiguous'
          WHEN l_quantity = 50 THEN 'invalid_identifier' ELSE 'unmatched' END AS status,
        CASE WHEN l_returnflag IN ('N', 'A') AND NOT first THEN l_partkey END AS matched_id,
        CASE WHEN l_returnflag IN ('N', 'A') AND NOT first THEN 'process_number_exact' END AS method,
        CASE WHEN l_returnflag IN ('N', 'A') AND l_tax > 0 AND NOT first THEN sha256(l_partkey::VARCHAR) END AS evidence,
        CASE WHEN l_quantity = 1 THEN ['missing_identifier'] WHEN l_quantity = 2 THEN ['page_continuation']
          ELSE {_NO_FLAGS} END AS quality_flags
        FROM lineitem JOIN (SELECT batch_id, run_id, run_id % 2 = 0 AND count(*) OVER (PARTITION BY batch_id) = 2 AS first FROM runs)
          ON batch_id = l_orderkey""",
    "targets": "SELECT p_partkey AS case_id, CASE WHEN p_size > 45 THEN 'inactive' ELSE 'active' END AS status FROM part",
    "reviews": f"""SELECT {_ITEM} || '#' || round AS review_id, {_ITEM} AS item_id, l_orderkey AS batch_id,
        l_orderkey * 2 AS run_id, l_linenumber + round * 10 AS review_revision,
        CASE WHEN l_quantity > 10 THEN 'corrected' WHEN l_quantity > 5 THEN 'reprocess_requested' ELSE 'returned' END
          AS decision,
        CASE WHEN l_quantity > 10 THEN l_partkey + round END AS after_id, l_suppkey % 20 AS reviewer,
        l_shipdate AS created_at,
        CASE WHEN l_quantity > 5 THEN 'EXISTING_ID_CONFIRMED' ELSE 'INVALID_IDENTIFIER_ACCEPTED_PENDING' END AS reason_code
        FROM lineitem, (SELECT unnest([0, 1]) AS round)
        WHERE l_returnflag = 'R' AND (round = 0 OR l_discount > 0.05::DOUBLE)""",
    "batch_links": f"""SELECT {_ITEM} AS link_id, {_ITEM} AS item_id, l_orderkey AS batch_id,
        CASE WHEN l_quantity = 3 THEN l_partkey + 1 ELSE l_partkey END AS entity_id,
        'process_number_exact' AS match_method,
        CASE WHEN l_tax > 0 THEN sha256(l_partkey::VARCHAR) END AS evidence,
        CASE WHEN l_linestatus = 'F' OR l_quantity < 40 THEN 'active' ELSE 'inactive' END AS status
        FROM lineitem WHERE l_returnflag IN ('N', 'A')""",
    "versions": """SELECT o_orderkey AS version_id, o_custkey AS partner_id, o_orderkey AS batch_id,
        date_trunc('month', o_orderdate)::DATE AS period_start, last_day(o_orderdate) AS period_end,
        1 + o_orderkey % 5 AS version,
        CASE o_orderstatus WHEN 'O' THEN 'validated' WHEN 'F' THEN 'published'
          ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'draft' WHEN '2-HIGH' THEN 'failed' ELSE 'superseded' END END
          AS status,
        o_orderdate + to_minutes(o_orderkey % 1440) AS generated_at, 'd' || (o_orderkey % 3) AS source_digest,
        o_orderkey % 40 AS customer_count, trunc(o_totalprice / 10000)::BIGINT AS case_count,
        CASE WHEN o_orderpriority <> '5-LOW' THEN 'obj/' || o_orderkey END AS storage_key,
        CAST(NULL AS TIMESTAMP) AS purged_at FROM orders""",
    "requests": """SELECT event_id AS request_id, user_id AS partner_id, event_id AS batch_id,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running'
          ELSE 'succeeded' END AS status, ts AS created_at, 'd' || (event_id % 3) AS source_digest FROM events""",
    "run_log": """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'P' THEN 'partial' ELSE 'succeeded' END AS status,
        o_orderdate AS finished_at FROM orders""",
    "changed_partners": "SELECT l_orderkey AS run_id, l_suppkey AS partner_id FROM lineitem",
    "audit_log": """SELECT event_id AS audit_id, ts AS occurred_at,
        CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'view' THEN 'report_view' WHEN 'signup' THEN 'account_created'
          WHEN 'click' THEN 'catalog_view' ELSE 'unknown_action' END AS action,
        CASE WHEN event_type = 'click' THEN 'none' ELSE 'user' END AS entity_type,
        CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'other_reason' ELSE 'rate_limited' END END
          AS reason_code FROM events""",
    "state_log": """SELECT conv_id AS batch_id, turn * (1 + conv_id % 3) AS seq,
        CASE WHEN turn = 0 OR conv_id % 5 = 4 THEN NULL ELSE names[(turn - 1) % 9 + 1] END AS from_state,
        CASE WHEN role = 'system' AND conv_id % 2 = 1 THEN 'failed' ELSE names[turn % 9 + 1] END AS to_state
        FROM conversations, (SELECT ['uploaded', 'quarantined', 'parsing', 'parsed', 'reconciling', 'needs_review',
          'approved', 'superseded', 'failed'] AS names)""",
    "users": """SELECT c_custkey AS user_id, c_name AS login,
        CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status FROM customer""",
    "roles": """SELECT r_regionkey::BIGINT AS role_id, CASE r_regionkey WHEN 0 THEN 'portal_admin' WHEN 1 THEN 'reviewer'
        ELSE lower(r_name) END AS role FROM region""",
    "user_roles": "SELECT DISTINCT o_custkey AS user_id, o_orderkey % 5 AS role_id FROM orders",
    "access_links": """SELECT o_orderkey AS link_id, o_custkey AS user_id, o_orderdate AS created_at,
        o_orderdate + INTERVAL 7 DAY AS expires_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS used_at FROM orders""",
    "raw_customers": """SELECT c_custkey AS seq, concat('{"id":', CASE WHEN c_acctbal < -500 THEN concat('"', c_custkey, '"')
          ELSE (c_custkey + 1)::VARCHAR END,
        ',"name":', CASE WHEN c_acctbal > 9500 THEN '17' ELSE concat('"', c_name, '"') END,
        ',"identification":"","origin":', CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'null'
          ELSE concat('" ', c_mktsegment, ' "') END,
        ',"created_at":"', CASE c_mktsegment WHEN 'BUILDING' THEN '2024-02-30' WHEN 'MACHINERY' THEN '2024-02-28T10:20:30Z'
          ELSE '2024-02-28 10:20:30' END, '"}') AS raw FROM customer""",
    "raw_cases": """SELECT o_orderkey AS seq, concat('{"id":', o_orderkey + 1, ',"process_number":"',
        lpad(o_orderkey::VARCHAR, 20, '0'), '","folder":', CASE WHEN o_orderpriority = '5-LOW' THEN '""'
          ELSE concat('"F-', o_custkey, '"') END,
        ',"step":"  Em   andamento ","stage":"', o_orderstatus, '","stages_id":',
        CASE WHEN o_orderpriority = '1-URGENT' THEN '0' ELSE '7' END,
        ',"responsible_id":', CASE WHEN o_orderpriority = '2-HIGH' THEN 'null' ELSE (o_custkey % 9)::VARCHAR END,
        ',"process_date":"', strftime(o_orderdate, '%Y-%m-%d'), 'T00:00:00"',
        ',"fees_expec":', CASE WHEN o_orderpriority = '3-MEDIUM' THEN '"12"' ELSE '1500.5' END,
        ',"customers":', CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN '{}' ELSE
          concat('[{"customer_id":', o_custkey + 1, ',"name":"A  B","origin":"x"},{"customer_id":',
            o_custkey + 18, ',"name":null,"origin":"', lower(o_orderstatus), '"},{"customer_id":0},{"customer_id":',
            o_custkey + 1, ',"name":"', o_orderstatus, '","origin":" X "}]') END, '}') AS raw FROM orders""",
    "raw_transactions": f"""SELECT {_HASH_ID} AS seq, concat('{{"id":', {_HASH_ID}, ',"lawsuit_id":',
        CASE WHEN l_discount = 0 THEN 'null' ELSE (l_orderkey + 1)::VARCHAR END, ',"amount":',
        CASE WHEN l_tax = 0 THEN 'null' WHEN l_quantity = 1 THEN '"9.90"'
          ELSE CAST(l_extendedprice AS DECIMAL(18,2))::VARCHAR END,
        ',"entry_type":"', CASE WHEN l_returnflag = 'R' THEN 'expense' ELSE 'income' END,
        '","category":"RPVS","date_due":"', strftime(l_shipdate, '%Y-%m-%d'), '","date_payment":',
        CASE WHEN l_linestatus = 'F' THEN concat('"', strftime(l_shipdate, '%Y-%m-%d'), '"') ELSE '""' END,
        ',"is_internal":', CASE WHEN l_quantity = 2 THEN '1' ELSE 'false' END, '}}') AS raw FROM lineitem""",
    "raw_movements": """SELECT event_id AS seq, concat('{"lawsuit_id":', user_id, ',"date":"',
        strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE event_type WHEN 'view' THEN 'Z' WHEN 'click' THEN '-03:00'
          WHEN 'error' THEN '+9' ELSE '' END, '","title":',
        CASE WHEN event_type = 'signup' THEN '""' ELSE concat('"', event_type, '"') END, '}') AS raw FROM events""",
    # Derived steps shared by several twins.
    "active_links": """SELECT * FROM links WHERE status = 'active' AND valid_from <= DATE '1998-01-01'
        AND (valid_to IS NULL OR valid_to >= DATE '1998-01-01')""",
    "known_pairs": "SELECT * FROM case_customers WHERE customer_id IN (SELECT customer_id FROM customers)",
    "case_sets": """SELECT k.case_id, l.partner_id FROM known_pairs k JOIN active_links l
          ON l.entity_type = 'customer' AND l.entity_id = k.customer_id
        UNION SELECT c.case_id, l.partner_id FROM cases c JOIN active_links l
          ON l.entity_type = 'case' AND l.entity_id = c.case_id""",
    "eligible": """SELECT min(partner_id) AS partner_id, case_id FROM case_sets GROUP BY case_id
        HAVING count(DISTINCT partner_id) = 1""",
    "entries": r"""SELECT * FROM (SELECT *, CASE
          WHEN side = 'INCOME' AND (contains(name, 'HONOR') OR name = 'RPVS') THEN 'fee_income'
          WHEN side = 'EXPENSE' AND name = 'TAXAS BANCÁRIAS' THEN 'bank_fee'
          WHEN side = 'EXPENSE' AND name = 'HONORÁRIOS DE PARCEIROS' THEN 'partner_payout' END AS kind
        FROM (SELECT *, trim(regexp_replace(upper(entry_type), '\s+', ' ', 'g')) AS side,
          trim(regexp_replace(upper(category), '\s+', ' ', 'g')) AS name FROM transactions))
        WHERE kind IS NOT NULL AND case_id IS NOT NULL""",
    "accounts": """SELECT *, net - partner_share AS office_revenue, partner_share - partner_paid AS balance
        FROM (SELECT *, CAST(round(CAST(net AS DECIMAL(30,6)) * CAST(percentage / 100 AS DECIMAL(8,4)), 2) AS DECIMAL(18,2))
            AS partner_share,
          CAST(round(CAST(future_income AS DECIMAL(26,3)) * CAST(0.925 * CAST(percentage / 100 AS DECIMAL(8,4))
            AS DECIMAL(12,7)), 2) AS DECIMAL(18,2)) AS partner_future
          FROM (SELECT *, CAST(paid_income - bank_fees - tax AS DECIMAL(18,2)) AS net
            FROM (SELECT *, CAST(round(CAST(paid_income AS DECIMAL(30,2)) * CAST(0.075 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) AS tax
              FROM (SELECT e.partner_id, e.case_id, p.percentage, count(n.kind) AS entries,
                  CAST(coalesce(sum(CASE WHEN kind = 'fee_income' AND date_payment IS NOT NULL THEN amount END), 0) AS DECIMAL(18,2)) AS paid_income,
                  CAST(coalesce(sum(CASE WHEN kind = 'bank_fee' AND date_payment IS NOT NULL THEN amount END), 0) AS DECIMAL(18,2)) AS bank_fees,
                  CAST(coalesce(sum(CASE WHEN kind = 'partner_payout' AND date_payment IS NOT NULL THEN amount END), 0) AS DECIMAL(18,2)) AS partner_paid,
                  CAST(coalesce(sum(CASE WHEN kind = 'fee_income' AND date_payment IS NULL THEN amount END), 0) AS DECIMAL(18,2)) AS future_income
                FROM eligible e JOIN partners p USING (partner_id) LEFT JOIN entries n ON n.case_id = e.case_id
                GROUP BY ALL))))""",
    "stage_flags": r"""SELECT case_id, step IN ('MARKETING', 'NEGOCIAÇÃO', 'CONSULTORIA', 'ADMINISTRATIVO', 'JUDICIAL', 'RECURSAL',
          'EXECUÇÃO/COBRANÇA', 'RH/FINANCEIRO', 'ARQUIVAMENTO') AS known,
        step IN ('JUDICIAL', 'RECURSAL', 'EXECUÇÃO/COBRANÇA') AS judicial,
        step = 'EXECUÇÃO/COBRANÇA' OR stage IN ('AGUARDANDO PAGAMENTO DOS HONORÁRIOS', 'HONORÁRIOS QUITADOS') AS benefit,
        stage = 'AGUARDANDO PAGAMENTO DOS HONORÁRIOS' AS awaiting_fees
        FROM (SELECT case_id, trim(regexp_replace(upper(step), '\s+', ' ', 'g')) AS step,
          trim(regexp_replace(upper(stage), '\s+', ' ', 'g')) AS stage FROM cases)""",
    "latest_moves": """SELECT case_id, occurred_at AS last_movement_at, title AS last_movement_title FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at DESC, movement_id) AS rn FROM movements
        WHERE occurred_at <= TIMESTAMP '2024-01-20 00:00:00') WHERE rn = 1 AND case_id IN (SELECT case_id FROM cases)""",
}
