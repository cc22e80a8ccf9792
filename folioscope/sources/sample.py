"""Portfolio model tables derived from the order, customer and event tables.

Only a mapping: each method is a projection (sometimes one join) of the stored tables, so that
every query works on whole tables. ``plans/tables_sql.py`` states the same mapping in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.spread import dealt
from folioscope.sources.tables import read_table

_HASH_ID = (
    "cast(conv(substring(sha2(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " cast(l_extendedprice as decimal(18,2))), 256), 1, 15), 16, 10) as bigint)"
)
_ATTEMPTS = "explode(if(state = 'needs_review', array(0, 1), array(0)))"
_RUN_IDS = ("batch_id * 2 + attempt as run_id", "batch_id", "created_at + make_dt_interval(0, attempt) as created_at")
_ITEM_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


class Model:
    """Portfolio tables over one folder of stored tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def stored(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name)

    # -- portfolio -----------------------------------------------------------------------

    def partners(self) -> DataFrame:
        return self.stored("nation").selectExpr(
            "cast(n_nationkey as bigint) as partner_id",
            "concat('P-', n_nationkey) as code",
            "n_name as name",
            "cast(5 + (n_nationkey % 4) * 5 as decimal(5,2)) as percentage",
            "if(n_regionkey = 4, 'inactive', 'active') as status",
        )

    def customers(self) -> DataFrame:
        return self.stored("customer").selectExpr(
            "c_custkey as customer_id",
            "c_name as name",
            "concat('DOC-', c_custkey) as identification",
            "if(c_mktsegment = 'HOUSEHOLD', null, c_mktsegment) as origin",
            "if(c_acctbal < 0, 'inactive', 'active') as status",
        )

    def cases(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as case_id",
            """case o_orderstatus
                 when 'F' then regexp_replace(lpad(cast(o_orderkey as string), 20, '0'),
                   '^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$', '$1-$2.$3.$4.$5.$6')
                 when 'O' then concat(' ', lpad(cast(o_orderkey as string), 20, '0'), ' ')
                 else if(o_orderpriority = '5-LOW', null, lpad(cast(o_orderkey as string), 19, '0'))
               end as process_number""",
            "if(o_orderpriority = '5-LOW', null, concat(' F/', o_custkey, ' ')) as folder",
            """case o_orderpriority when '1-URGENT' then 'Execução/Cobrança' when '2-HIGH' then 'JUDICIAL'
                 when '3-MEDIUM' then ' recursal' when '4-NOT SPECIFIED' then 'RH/FINANCEIRO'
                 else 'ETAPA NOVA' end as step""",
            """case o_orderstatus when 'F' then 'HONORÁRIOS QUITADOS'
                 when 'O' then 'Aguardando  pagamento dos honorários' else 'RPV EMITIDO' end as stage""",
            "concat('R', o_custkey % 50) as responsible",
            "o_orderpriority as contingency",
            "cast(o_totalprice as decimal(18,2)) as fees_expected",
            "cast(o_orderdate as date) as opened_on",
            "if(o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P', 'inactive', 'active') as status",
        )

    def case_customers(self) -> DataFrame:
        """Up to three customers per case, some of them unknown."""
        return self.stored("orders").selectExpr(
            "o_orderkey as case_id",
            """explode(array_distinct(array_compact(array(
                 o_custkey,
                 if(o_orderpriority in ('1-URGENT', '2-HIGH'), o_custkey + 17, null),
                 if(o_orderpriority = '5-LOW', o_custkey + 1000000000, null))))) as customer_id""",
        )

    def links(self) -> DataFrame:
        of_customers = self.stored("customer").filter("c_mktsegment <> 'BUILDING'").selectExpr(
            "c_custkey as link_id",
            "cast(c_nationkey as bigint) as partner_id",
            "'customer' as entity_type",
            "c_custkey as entity_id",
            "date_add(date'1994-01-01', cast(c_custkey % 5 as int) * 500) as valid_from",
            "if(c_mktsegment = 'MACHINERY', date_add(date'1994-01-01', cast(c_custkey % 5 as int) * 500 + 700), null)"
            " as valid_to",
            "if(c_acctbal < 0, 'inactive', 'active') as status",
        )
        of_cases = self.stored("orders").filter("o_orderpriority = '3-MEDIUM'").selectExpr(
            "10000000000 + o_orderkey as link_id",
            "o_orderkey % 25 as partner_id",
            "'case' as entity_type",
            "if(o_orderstatus = 'P', o_orderkey + 1000000000, o_orderkey) as entity_id",
            "cast(o_orderdate as date) as valid_from",
            "cast(null as date) as valid_to",
            "'active' as status",
        )
        return of_customers.unionByName(of_cases)

    def transactions(self) -> DataFrame:
        return self.stored("lineitem").selectExpr(
            f"{_HASH_ID} as entry_id",
            "case when l_discount = 0 then null when l_quantity = 1 then l_orderkey + 1000000000"
            " else l_orderkey end as case_id",
            "if(l_tax = 0, null, cast(l_extendedprice as decimal(18,2))) as amount",
            "if(l_returnflag = 'R', 'expense', 'income') as entry_type",
            """if(l_returnflag = 'R',
                 case l_linenumber % 3 when 0 then 'Taxas  bancárias' when 1 then 'HONORÁRIOS DE PARCEIROS'
                   else 'SALÁRIOS' end,
                 case l_linenumber % 4 when 0 then 'RPVS' when 1 then 'HONORÁRIOS INICIAIS'
                   when 2 then 'honorários  finais' else 'REEMBOLSO' end) as category""",
            "cast(l_shipdate as date) as date_due",
            "if(l_linestatus = 'F', cast(l_shipdate as date), null) as date_payment",
        )

    def movements(self) -> DataFrame:
        return self.stored("events").selectExpr(
            "event_id as movement_id",
            "user_id as case_id",
            "ts as occurred_at",
            # Each source has its own offset, from three hours behind to five ahead.
            "cast(ts + make_interval(0, 0, 0, 0, cast(user_id % 9 - 3 as int)) as date) as occurred_on",
            "event_type as title",
        )

    # -- reconciliation ------------------------------------------------------------------

    def manifest(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as item_id",
            "o_custkey as doc_id",
            "o_orderkey as ordinal",
            """case o_orderstatus
                 when 'F' then regexp_replace(lpad(cast(o_orderkey as string), 20, '0'),
                   '^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$', '$1-$2.$3.$4.$5.$6')
                 when 'O' then lpad(cast(if(o_orderpriority = '2-HIGH', o_orderkey + 500000000, o_orderkey) as string),
                   20, '0')
                 else if(o_orderpriority = '1-URGENT', 'ABC', null) end as process_number""",
            """case when o_orderstatus = 'O' then null
                 when o_orderstatus = 'F' then if(o_orderpriority = '2-HIGH', 'F-X', null)
                 when o_orderpriority = '2-HIGH' then concat(' F-', 1000000000 + o_orderkey, ' ')
                 when o_orderpriority = '3-MEDIUM' then concat('F-', o_custkey)
                 when o_orderpriority = '4-NOT SPECIFIED' then ' '
                 else concat('F-', 1000000000 + o_orderkey) end as folder""",
            """case when o_totalprice < 5000 then array('incomplete_block')
                 when o_totalprice < 10000 then array('page_continuation')
                 when o_totalprice < 12000 then array('duplicate_source')
                 else cast(array() as array<string>) end as quality_flags""",
        )

    def candidates(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as external_id",
            """case o_orderpriority when '5-LOW' then null
                 when '4-NOT SPECIFIED' then lpad(cast(o_orderkey - o_orderkey % 3 as string), 20, '0')
                 else lpad(cast(o_orderkey as string), 20, '0') end as process_number""",
            """case o_orderpriority when '3-MEDIUM' then concat('F-', o_custkey) when '1-URGENT' then null
                 else concat('F-', 1000000000 + o_orderkey) end as folder""",
            "sha2(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority), 256) as record_digest",
            "o_custkey as customer_id",
        )

    # -- import batches ------------------------------------------------------------------

    def directory(self) -> DataFrame:
        """Partners at scale: one per stored customer."""
        return self.stored("customer").selectExpr(
            "c_custkey as partner_id",
            "concat(if(c_mktsegment = 'BUILDING', 'SYNTHETIC-', 'P-'), c_custkey) as external_id",
            "c_name as name",
            "if(c_acctbal < 0, 'inactive', 'active') as status",
            "if(c_custkey % 23 = 0, timestamp'1998-01-01', null) as deleted_at",
            "c_mktsegment in ('MACHINERY', 'FURNITURE') as pilot_enabled",
            "cast(c_acctbal / 100 as decimal(5,2)) as percentage",
        )

    def _uploads(self) -> DataFrame:
        """Batches without the number of their items."""
        return self.stored("orders").selectExpr(
            "o_orderkey as batch_id",
            "o_custkey as partner_id",
            "o_custkey as source_id",
            """case o_orderstatus when 'F' then 'approved' when 'O' then 'needs_review'
                 else case o_orderpriority when '1-URGENT' then 'quarantined' when '2-HIGH' then 'parsed'
                   when '3-MEDIUM' then 'rejected' when '4-NOT SPECIFIED' then 'superseded' else 'failed' end
               end as state""",
            """case o_orderpriority when '1-URGENT' then 'failed' when '2-HIGH' then 'running'
                 when '3-MEDIUM' then 'pending' else 'succeeded' end as processing_status""",
            "cast(date_trunc('month', o_orderdate) as date) as period_start",
            "last_day(o_orderdate) as period_end",
            "o_orderdate as created_at",
            "o_orderdate as updated_at",
            "if(o_orderpriority in ('4-NOT SPECIFIED', '5-LOW'), o_orderdate + interval 1 day, null)"
            " as processing_finished_at",
            "o_custkey % 20 as uploaded_by",
            "'v1' as parser_version",
            "if(o_orderstatus = 'P', 1, 0) as extra_items",
        )

    def batches(self) -> DataFrame:
        counted = self.stored("lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(
            F.count(F.lit(1)).alias("n_items")
        )
        count = F.coalesce("n_items", F.lit(0)) + F.col("extra_items")
        return (
            self._uploads()
            .join(counted, "batch_id", "left")
            .withColumn("parsed_item_count", count)
            .drop("extra_items", "n_items")
        )

    def run_ids(self) -> DataFrame:
        """The runs without what they counted."""
        return self._uploads().withColumn("attempt", F.expr(_ATTEMPTS)).selectExpr(*_RUN_IDS)

    def runs(self) -> DataFrame:
        """One reconciliation run per batch, two for open orders."""
        return (
            self.batches()
            .withColumn("attempt", F.expr(_ATTEMPTS))
            .selectExpr(
                *_RUN_IDS,
                "if(processing_status = 'running', 'v0', 'v1') as parser_version",
                "parsed_item_count as result_total",
                "parsed_item_count - if(attempt = 0, 2, 0) as matched_count",
                "parsed_item_count + batch_id % 3 - 1 as snapshot_total",
                "created_at + make_dt_interval(cast(batch_id % 40 as int)) as snapshot_verified_at",
                "concat('snap-', batch_id % 7) as snapshot_sha256",
            )
        )

    def items(self, deal: bool = False) -> DataFrame:
        """Reconciliation items of every run. A batch that ran twice had matched nothing at first.

        With ``deal`` they lie in as many tasks as ``spread.dealt`` makes, for jobs that keep much of a task's rows.
        """
        first = "(attempt = 0 and runs = 2)"
        runs = self._uploads().selectExpr("batch_id as l_orderkey", "if(state = 'needs_review', 2, 1) as runs")
        attempts = F.expr("explode(sequence(0, runs - 1))")
        lines = self.stored("lineitem")
        return (dealt(lines, "l_orderkey") if deal else lines).join(runs, "l_orderkey").withColumn("attempt", attempts).selectExpr(
            f"if({first}, concat({_ITEM_ID}, '/first'), {_ITEM_ID}) as item_id",
            "l_orderkey as batch_id",
            "l_orderkey * 2 + attempt as run_id",
            "cast(l_linenumber as bigint) as ordinal",
            f"""case when {first} then 'unmatched' when l_returnflag in ('N', 'A') then 'matched' when l_linestatus = 'F' then 'ambiguous'
                 when l_quantity = 50 then 'invalid_identifier' else 'unmatched' end as status""",
            f"if(l_returnflag in ('N', 'A') and not {first}, l_partkey, null) as matched_id",
            f"if(l_returnflag in ('N', 'A') and not {first}, 'process_number_exact', null) as method",
            f"if(l_returnflag in ('N', 'A') and l_tax > 0 and not {first}, sha2(cast(l_partkey as string), 256), null) as evidence",
            """if(l_quantity = 1, array('missing_identifier'),
                 if(l_quantity = 2, array('page_continuation'), cast(array() as array<string>))) as quality_flags""",
        )

    def targets(self) -> DataFrame:
        return self.stored("part").selectExpr(
            "p_partkey as case_id", "if(p_size > 45, 'inactive', 'active') as status"
        )

    def reviews(self) -> DataFrame:
        """Decisions on items that did not match; a part of them was decided twice."""
        return (
            self.stored("lineitem")
            .filter("l_returnflag = 'R'")
            .withColumn("round", F.expr("explode(if(l_discount > 0.05D, array(0, 1), array(0)))"))
            .selectExpr(
                f"concat({_ITEM_ID}, '#', round) as review_id",
                f"{_ITEM_ID} as item_id",
                "l_orderkey as batch_id",
                "l_orderkey * 2 as run_id",
                "l_linenumber + round * 10 as review_revision",
                """case when l_quantity > 10 then 'corrected' when l_quantity > 5 then 'reprocess_requested'
                     else 'returned' end as decision""",
                "if(l_quantity > 10, l_partkey + round, null) as after_id",
                "l_suppkey % 20 as reviewer",
                "l_shipdate as created_at",
                "if(l_quantity > 5, 'EXISTING_ID_CONFIRMED', 'INVALID_IDENTIFIER_ACCEPTED_PENDING') as reason_code",
            )
        )

    def batch_links(self) -> DataFrame:
        """Links that approval wrote for matched items."""
        return self.stored("lineitem").filter("l_returnflag in ('N', 'A')").selectExpr(
            f"{_ITEM_ID} as link_id",
            f"{_ITEM_ID} as item_id",
            "l_orderkey as batch_id",
            "if(l_quantity = 3, l_partkey + 1, l_partkey) as entity_id",
            "'process_number_exact' as match_method",
            "if(l_tax > 0, sha2(cast(l_partkey as string), 256), null) as evidence",
            "if(l_linestatus = 'F' or l_quantity < 40, 'active', 'inactive') as status",
        )

    # -- report versions and logs --------------------------------------------------------

    def versions(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as version_id",
            "o_custkey as partner_id",
            "o_orderkey as batch_id",
            "cast(date_trunc('month', o_orderdate) as date) as period_start",
            "last_day(o_orderdate) as period_end",
            "1 + o_orderkey % 5 as version",
            """case o_orderstatus when 'O' then 'validated' when 'F' then 'published'
                 else case o_orderpriority when '1-URGENT' then 'draft' when '2-HIGH' then 'failed'
                   else 'superseded' end end as status""",
            "o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int)) as generated_at",
            "concat('d', o_orderkey % 3) as source_digest",
            "o_orderkey % 40 as customer_count",
            "cast(o_totalprice / 10000 as bigint) as case_count",
            "if(o_orderpriority = '5-LOW', null, concat('obj/', o_orderkey)) as storage_key",
            "cast(null as timestamp) as purged_at",
        )

    def requests(self) -> DataFrame:
        return self.stored("events").selectExpr(
            "event_id as request_id",
            "user_id as partner_id",
            "event_id as batch_id",
            """case event_type when 'error' then 'failed' when 'view' then 'pending' when 'signup' then 'running'
                 else 'succeeded' end as status""",
            "ts as created_at",
            "concat('d', event_id % 3) as source_digest",
        )

    def run_log(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as run_id",
            "case o_orderstatus when 'P' then 'partial' else 'succeeded' end as status",
            "o_orderdate as finished_at",
        )

    def changed_partners(self) -> DataFrame:
        return self.stored("lineitem").selectExpr("l_orderkey as run_id", "l_suppkey as partner_id")

    def audit_log(self) -> DataFrame:
        return self.stored("events").selectExpr(
            "event_id as audit_id",
            "ts as occurred_at",
            """case event_type when 'error' then 'login_failed' when 'view' then 'report_view'
                 when 'signup' then 'account_created' when 'click' then 'catalog_view'
                 else 'unknown_action' end as action""",
            "if(event_type = 'click', 'none', 'user') as entity_type",
            "if(event_type = 'error', if(value > 50, 'other_reason', 'rate_limited'), null) as reason_code",
        )

    def state_log(self) -> DataFrame:
        """State changes of one import per conversation, one per turn; the numbers of some leave gaps."""
        states = (
            "array('uploaded', 'quarantined', 'parsing', 'parsed', 'reconciling', 'needs_review', 'approved',"
            " 'superseded', 'failed')"
        )
        return self.stored("conversations").selectExpr(
            "conv_id as batch_id",
            "turn * (1 + conv_id % 3) as seq",
            f"if(turn = 0 or conv_id % 5 = 4, null, element_at({states}, cast((turn - 1) % 9 as int) + 1)) as from_state",
            f"if(role = 'system' and conv_id % 2 = 1, 'failed', element_at({states}, cast(turn % 9 as int) + 1)) as to_state",
        )

    # -- accounts ------------------------------------------------------------------------

    def users(self) -> DataFrame:
        return self.stored("customer").selectExpr(
            "c_custkey as user_id", "c_name as login", "if(c_acctbal < 0, 'disabled', 'active') as status"
        )

    def roles(self) -> DataFrame:
        return self.stored("region").selectExpr(
            "cast(r_regionkey as bigint) as role_id",
            "case r_regionkey when 0 then 'portal_admin' when 1 then 'reviewer' else lower(r_name) end as role",
        )

    def user_roles(self) -> DataFrame:
        return self.stored("orders").selectExpr("o_custkey as user_id", "o_orderkey % 5 as role_id").distinct()

    def access_links(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as link_id",
            "o_custkey as user_id",
            "o_orderdate as created_at",
            "o_orderdate + interval 7 day as expires_at",
            "if(o_orderstatus = 'F', o_orderdate + interval 1 day, null) as used_at",
        )

    # -- raw records ---------------------------------------------------------------------

    def raw_customers(self) -> DataFrame:
        """JSON text of customer records, some of them malformed."""
        return self.stored("customer").selectExpr(
            "c_custkey as seq",
            """concat('{"id":', case when c_acctbal < -500 then concat('"', c_custkey, '"') else cast(c_custkey + 1 as string) end,
                 ',"name":', if(c_acctbal > 9500, '17', concat('"', c_name, '"')),
                 ',"identification":"","origin":', if(c_mktsegment = 'HOUSEHOLD', 'null', concat('" ', c_mktsegment, ' "')),
                 ',"created_at":"', if(c_mktsegment = 'BUILDING', '2024-02-30', if(c_mktsegment = 'MACHINERY',
                     '2024-02-28T10:20:30Z', '2024-02-28 10:20:30')), '"}') as raw""",
        )

    def raw_cases(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey as seq",
            """concat('{"id":', cast(o_orderkey + 1 as string), ',"process_number":"',
                 lpad(cast(o_orderkey as string), 20, '0'), '","folder":', if(o_orderpriority = '5-LOW', '""',
                   concat('"F-', cast(o_custkey as string), '"')),
                 ',"step":"  Em   andamento ","stage":"', o_orderstatus, '","stages_id":', if(o_orderpriority = '1-URGENT', '0', '7'),
                 ',"responsible_id":', if(o_orderpriority = '2-HIGH', 'null', cast(o_custkey % 9 as string)),
                 ',"process_date":"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00"',
                 ',"fees_expec":', if(o_orderpriority = '3-MEDIUM', '"12"', '1500.5'),
                 ',"customers":', case when o_orderstatus = 'P' and o_orderpriority = '4-NOT SPECIFIED' then '{}' else
                   concat('[{"customer_id":', cast(o_custkey + 1 as string), ',"name":"A  B","origin":"x"},{"customer_id":',
                     cast(o_custkey + 18 as string), ',"name":null,"origin":"', lower(o_orderstatus), '"},{"customer_id":0},{"customer_id":',
                     cast(o_custkey + 1 as string), ',"name":"', o_orderstatus, '","origin":" X "}]') end, '}') as raw""",
        )

    def raw_transactions(self) -> DataFrame:
        return self.stored("lineitem").selectExpr(
            f"{_HASH_ID} as seq",
            f"""concat('{{"id":', cast({_HASH_ID} as string), ',"lawsuit_id":', if(l_discount = 0, 'null', cast(l_orderkey + 1 as string)),
                 ',"amount":', case when l_tax = 0 then 'null' when l_quantity = 1 then '"9.90"' else cast(cast(l_extendedprice as decimal(18,2)) as string) end,
                 ',"entry_type":"', if(l_returnflag = 'R', 'expense', 'income'), '","category":"RPVS","date_due":"',
                 date_format(l_shipdate, 'yyyy-MM-dd'), '","date_payment":', if(l_linestatus = 'F',
                   concat('"', date_format(l_shipdate, 'yyyy-MM-dd'), '"'), '""'), ',"is_internal":', if(l_quantity = 2, '1', 'false'), '}}') as raw""",
        )

    def raw_movements(self) -> DataFrame:
        return self.stored("events").selectExpr(
            "event_id as seq",
            """concat('{"lawsuit_id":', cast(user_id as string), ',"date":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                 case event_type when 'view' then 'Z' when 'click' then '-03:00' when 'error' then '+9' else '' end,
                 '","title":', if(event_type = 'signup', '""', concat('"', event_type, '"')), '}') as raw""",
        )
