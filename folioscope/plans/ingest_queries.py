"""Sources, sinks, scalar functions and normalisation queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import formats
from folioscope.functions import scalars as s
from folioscope.operators.links import effective_on
from folioscope.plans.registry import query
from folioscope.session import work_folder
from folioscope.sources import normalize, paged, pages, sinks, synthetic, tables

PAGE_SIZE = 100


def records(raw: DataFrame) -> DataFrame:
    return raw.select("seq", F.parse_json("raw").alias("record"))


def attributes(raw: DataFrame, *names: str) -> DataFrame:
    return s.open_record(records(raw), names)


def landed(raw: DataFrame, resource: str) -> DataFrame:
    """Pages of a hundred records; a page never holds more, so the list stays small."""
    total = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = F.floor(F.col("seq") / PAGE_SIZE) * PAGE_SIZE
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda r: r["raw"]), ",")
    grouped = raw.groupBy(page.cast("bigint").alias("requested_offset")).agg(body.alias("body"))
    head, offset = F.lit('{"data":['), F.col("requested_offset").cast("string")
    return grouped.select(
        F.lit(resource).alias("resource"),
        "requested_offset",
        F.lit(PAGE_SIZE).cast("bigint").alias("requested_limit"),
        F.concat(
            head, "body", F.lit('],"totalCount":'), total.cast("string"), F.lit(f',"limit":{PAGE_SIZE},"offset":'), offset, F.lit("}")
        ).alias("payload"),
    )


def landed_sql(raw: str) -> str:
    return f"""SELECT (seq // {PAGE_SIZE}) * {PAGE_SIZE} AS requested_offset, concat('{{"data":[', string_agg(raw, ',' ORDER BY seq),
       '],"totalCount":', (SELECT count(*) FROM {raw}), ',"limit":{PAGE_SIZE},"offset":', (seq // {PAGE_SIZE}) * {PAGE_SIZE}, '}}') AS payload
       FROM {raw} GROUP BY (seq // {PAGE_SIZE}) * {PAGE_SIZE}"""


def damaged(frame: DataFrame) -> DataFrame:
    """Pages of which some break one rule each, chosen by their number."""
    number = F.floor(F.col("requested_offset") / PAGE_SIZE) % 8
    text = F.col("payload")
    payload = (
        F.when(number == 1, F.regexp_replace(text, '"totalCount":', '"totalCount":"x","t":'))
        .when(number == 2, F.lit("no json"))
        .when(number == 3, F.regexp_replace(text, '"limit":100', '"limit":50'))
        .when(number == 4, F.lit('{"data":[],"totalCount":100000000,"limit":100,"offset":0}'))
        .when(number == 5, F.regexp_replace(text, r'"totalCount":\d+', '"totalCount":1'))
        .when(number == 6, F.regexp_replace(text, r'"data":\[', '"data":[5,'))
        .otherwise(text)
    )
    return frame.withColumn("payload", payload)


# -- JSON helpers for the SQL twins -----------------------------------------------------------


def kind(name: str) -> str:
    return f"json_type(raw::JSON, '$.{name}')"


def text(name: str) -> str:
    return f"(raw::JSON ->> '$.{name}')"


def is_int(name: str) -> str:
    return f"coalesce({kind(name)} IN ('UBIGINT', 'BIGINT'), FALSE)"


def id_value(name: str) -> str:
    return f"CASE WHEN {is_int(name)} AND TRY_CAST({text(name)} AS BIGINT) > 0 THEN TRY_CAST({text(name)} AS BIGINT) END"


def blank(name: str) -> str:
    return f"({kind(name)} IS NULL OR {kind(name)} = 'NULL' OR ({kind(name)} = 'VARCHAR' AND {text(name)} = ''))"


def id_error(name: str, required: bool = False) -> str:
    missing = f"'{name}_missing'" if required else "NULL"
    return (
        f"CASE WHEN {blank(name)} OR ({is_int(name)} AND {text(name)} = '0') THEN {missing} "
        f"WHEN NOT {is_int(name)} THEN '{name}_invalid' END"
    )


def text_value(name: str) -> str:
    return f"CASE WHEN {kind(name)} = 'VARCHAR' THEN nullif({text(name)}, '') END"


def text_error(name: str) -> str:
    return f"CASE WHEN coalesce({kind(name)}, 'NULL') NOT IN ('NULL', 'VARCHAR') THEN '{name}_invalid' END"


def date_value(name: str) -> str:
    return f"CASE WHEN {kind(name)} = 'VARCHAR' THEN TRY_CAST(substr({text(name)}, 1, 10) AS DATE) END"


def date_error(name: str) -> str:
    return f"CASE WHEN NOT {blank(name)} AND {date_value(name)} IS NULL THEN '{name}_invalid' END"


def moment_value(name: str) -> str:
    t = text(name)
    return f"""CASE WHEN {kind(name)} = 'VARCHAR' THEN CASE
        WHEN regexp_matches({t}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN timezone('UTC', TRY_CAST({t} AS TIMESTAMPTZ))
        WHEN regexp_matches({t}, '[+-][0-9]$') THEN NULL
        ELSE timezone('UTC', timezone('America/Sao_Paulo', TRY_CAST({t} AS TIMESTAMP))) END END"""


def moment_error(name: str, required: bool = False) -> str:
    missing = f"'{name}_missing'" if required else "NULL"
    return f"CASE WHEN {blank(name)} THEN {missing} WHEN {moment_value(name)} IS NULL THEN '{name}_invalid' END"


def money_value(name: str) -> str:
    return f"CASE WHEN {kind(name)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({text(name)} AS DECIMAL(18,2)) END"


# -- sources and sinks ------------------------------------------------------------------------


S1_SQL = f"""SELECT (seq // {PAGE_SIZE}) * {PAGE_SIZE} AS requested_offset, row_number() OVER (PARTITION BY seq // {PAGE_SIZE} ORDER BY seq) - 1 AS position,
        {text('name')} AS name FROM raw_customers"""


@query(
    "s1_read_pages",
    "requested_offset l, position l, name s",
    S1_SQL,
)
def s1(m):
    """Pages are landed as JSON lines in the shared work folder and read back."""
    folder = work_folder(m.spark, "landed-pages")
    landed(m.raw_customers(), "customers").write.json(folder)
    found = pages.page_records(pages.read_pages(m.spark, folder, "customers"))
    return s.open_record(found, ["name"]).withColumnRenamed("_name_text", "name")


def _paged(m, raw, resource: str, source: str):
    """A reader of the collection's pages, through the paged source."""
    folder = work_folder(m.spark, "page-store")
    paged.land_pages(landed(raw, resource), folder)
    paged.register(m.spark, source, paged.from_folder(folder))
    return {"resource": resource, "page_size": str(PAGE_SIZE), "pages_per_task": "4"}, folder


@query("s1_paged_source", "requested_offset l, position l, name s", S1_SQL)
def s1_paged(m):
    """The collection page by page: ranges of pages are the partitions."""
    options, _ = _paged(m, m.raw_customers(), "customers", "customer_pages")
    found = m.spark.read.format("customer_pages").options(**options).load()
    return s.open_record(pages.page_records(pages.parse_pages(found)), ["name"]).withColumnRenamed("_name_text", "name")


@query("s1_paged_stream", "requested_offset l, position l, name s", S1_SQL)
def s1_stream(m):
    """The same collection as a stream, drained into a table of landed pages."""
    options, folder = _paged(m, m.raw_customers(), "customers", "customer_page_stream")
    stream = m.spark.readStream.format("customer_page_stream").options(**options).load()
    drained = stream.writeStream.format("parquet").option("path", f"{folder}-read").option("checkpointLocation", f"{folder}-checkpoint")
    drained.trigger(availableNow=True).start().awaitTermination()
    found = m.spark.read.schema(pages.LANDED_SCHEMA).parquet(f"{folder}-read")
    return s.open_record(pages.page_records(pages.parse_pages(found)), ["name"]).withColumnRenamed("_name_text", "name")


@query(
    "s3_paged_scan",
    "pages l, records l, page_violations l, gaps l, complete b",
    f"""SELECT count(*) AS pages, sum(CASE WHEN page = 1 THEN 0 ELSE n END) AS records, count_if(page = 1) AS page_violations,
          count_if(page = 1) AS gaps, count_if(page = 1) = 0 AS complete
        FROM (SELECT seq // {PAGE_SIZE} AS page, count(*) AS n FROM raw_cases GROUP BY 1)""",
)
def s3_paged(m):
    """A scan of a collection whose second page can't be had."""
    folder = work_folder(m.spark, "page-store")
    paged.land_pages(landed(m.raw_cases(), "lawsuits").filter(f"requested_offset <> {PAGE_SIZE}"), folder)
    paged.register(m.spark, "case_pages", paged.from_folder(folder))
    found = m.spark.read.format("case_pages").option("resource", "lawsuits").option("page_size", str(PAGE_SIZE)).load()
    return pages.check_scan(pages.parse_pages(found))


@query(
    "s2_check_pages",
    "requested_offset l, row_count l, violation s",
    f"""SELECT requested_offset, CASE n WHEN 2 THEN 0 WHEN 4 THEN 0 WHEN 6 THEN size + 1 ELSE size END AS row_count,
        CASE n WHEN 1 THEN 'envelope_invalid' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'echo_mismatch' WHEN 5 THEN 'overrun'
          WHEN 4 THEN 'echo_mismatch'
          WHEN 6 THEN CASE WHEN size + 1 > {PAGE_SIZE} THEN 'size_invalid' ELSE 'record_invalid' END END AS violation
        FROM (SELECT requested_offset, (requested_offset // {PAGE_SIZE}) % 8 AS n,
          json_array_length(payload::JSON, '$.data')::BIGINT AS size FROM ({landed_sql('raw_cases')}))""",
)
def s2(m):
    return pages.check_pages(pages.parse_pages(damaged(landed(m.raw_cases(), "lawsuits"))))


@query(
    "s3_check_scan",
    "scan s, pages l, records l, gaps l, repeated_across_pages l, complete b",
    f"""SELECT 'customers' AS scan, count(*) AS pages, sum(n) AS records, 0 AS gaps, 0 AS repeated_across_pages,
          TRUE AS complete
        FROM (SELECT count(*) AS n FROM raw_customers GROUP BY seq // {PAGE_SIZE})
        UNION ALL SELECT 'cases', count(*), sum(n), 1, 0, FALSE FROM (SELECT count(*) AS n FROM raw_cases GROUP BY seq // {PAGE_SIZE}
          HAVING seq // {PAGE_SIZE} <> 1)
        UNION ALL SELECT 'shifted', count(*), sum(n), 0, {PAGE_SIZE}, FALSE FROM (SELECT count(*) AS n FROM raw_cases GROUP BY seq // {PAGE_SIZE})""",
)
def s3(m):
    """A whole scan, one whose second page was lost, and one whose second page repeats the first."""
    whole = pages.parse_pages(landed(m.raw_customers(), "customers"))
    lost = pages.parse_pages(landed(m.raw_cases(), "lawsuits").filter(f"requested_offset <> {PAGE_SIZE}"))
    again = m.raw_cases().withColumn(
        "raw",
        F.when(
            F.col("seq").between(PAGE_SIZE, 2 * PAGE_SIZE - 1),
            F.concat(F.lit('{"id":'), (F.col("seq") - PAGE_SIZE + 1).cast("string"), F.lit("}")),
        ).otherwise(F.col("raw")),
    )
    shifted = pages.parse_pages(landed(again, "lawsuits"))
    parts = [
        pages.check_scan(frame).withColumn("scan", F.lit(name))
        for name, frame in (("customers", whole), ("cases", lost), ("shifted", shifted))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "s4_read_table",
    "l_orderkey l, l_linenumber l, l_quantity l",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def s4(m):
    wanted = m.stored("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.read_ids(m.stored("lineitem"), "l_orderkey", wanted)


@query(
    "s5_count_summary",
    "value s",
    """SELECT concat('{"cases":', count(*), ',"without_number":', count(*) - count(process_number), ',"inactive":',
       count_if(status = 'inactive'), '}') AS value FROM cases""",
)
def s5(m):
    summary = m.cases().agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("process_number").isNull()).alias("without_number"),
        F.count_if(F.col("status") == "inactive").alias("inactive"),
    )
    folder = work_folder(m.spark, "summary")
    sinks.write_summary(summary, folder)
    return m.spark.read.text(folder)


@query(
    "s6_synthetic_portfolios",
    "partner_id l, case_id l, customer_id l, movement_age n",
    """SELECT partner_id, partner_id * 1000 + i AS case_id, partner_id * 1000 + i % people AS customer_id,
         CASE WHEN i % 7 <> 0 THEN i % 19 + 1 END AS movement_age
       FROM (SELECT partner_id, CASE status WHEN 'inactive' THEN 0 ELSE CASE WHEN pilot_enabled THEN 55 ELSE 1 END END AS n,
         CASE WHEN pilot_enabled THEN 30 ELSE 1 END AS people FROM directory), (SELECT unnest(range(55)) AS i) WHERE i < n""",
)
def s6(m):
    """A generated portfolio for every partner of the directory, by scenario."""
    scenario = F.when(F.col("status") == "inactive", "zero").when(F.col("pilot_enabled"), "many").otherwise("one")
    wanted = m.directory().select("partner_id", scenario.alias("scenario"))
    return synthetic.synthetic_cases(wanted)


@query(
    "s7_report_version",
    "partner_id l, period_end d, version l, cases l",
    """WITH report AS (SELECT partner_id, (date_trunc('year', opened_on) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE AS period_end, case_id
         FROM eligible JOIN cases USING (case_id))
       SELECT partner_id, period_end, 1 AS version, count_if(partner_id % 2 = 1 OR case_id % 2 = 0) AS cases FROM report GROUP BY ALL
         HAVING count_if(partner_id % 2 = 1 OR case_id % 2 = 0) > 0
       UNION ALL SELECT partner_id, period_end, 2, count(*) FROM report WHERE partner_id % 3 = 0 GROUP BY ALL""",
)
def s7(m):
    """Slices per partner and year in several writes: two of version 1, one of a slice again, one of version 2."""
    from folioscope.plans.steps import eligible_cases

    report = eligible_cases(m).join(m.cases().select("case_id", "opened_on"), "case_id").select(
        "partner_id", F.make_date(F.year("opened_on"), F.lit(12), F.lit(31)).alias("period_end"), "case_id"
    )
    folder = work_folder(m.spark, "reports")
    sinks.write_report_version(report.filter("partner_id % 2 = 1"), folder, version=1)
    sinks.write_report_version(report.filter("partner_id % 2 = 0 and case_id % 2 = 0"), folder, version=1)
    sinks.write_report_version(report.filter("partner_id % 2 = 0 and case_id % 2 = 0"), folder, version=1)
    sinks.write_report_version(report.filter("partner_id % 3 = 0"), folder, version=2)
    visible = sinks.read_reports(m.spark, folder)
    return visible.groupBy("partner_id", "period_end", "version").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "s9_external_view",
    "code s, display s",
    "SELECT external_id AS code, upper(name) AS display FROM directory",
)
def s9(m):
    shown = m.directory().withColumnRenamed("external_id", "code")
    return tables.external_view(shown, ["code", "display"], {"display": F.upper("name")})


# -- scalar functions -------------------------------------------------------------------------


@query(
    "n1_positive_id",
    "seq l, stage_id n, responsible_id n, error s",
    f"""SELECT seq, {id_value('stages_id')} AS stage_id, {id_value('responsible_id')} AS responsible_id,
        {id_error('stages_id', True)} AS error FROM raw_cases""",
)
def n1(m):
    return attributes(m.raw_cases(), "stages_id", "responsible_id").select(
        "seq",
        s.positive_id(s.opened("stages_id")).alias("stage_id"),
        s.positive_id(s.opened("responsible_id")).alias("responsible_id"),
        s.positive_id_error(s.opened("stages_id"), "stages_id", required=True).alias("error"),
    )


@query(
    "n2_text",
    "seq l, name s, identification s, error s",
    f"SELECT seq, {text_value('name')} AS name, {text_value('identification')} AS identification, {text_error('name')} AS error FROM raw_customers",
)
def n2(m):
    return attributes(m.raw_customers(), "name", "identification").select(
        "seq",
        s.text_or_null(s.opened("name")).alias("name"),
        s.text_or_null(s.opened("identification")).alias("identification"),
        s.text_error(s.opened("name"), "name").alias("error"),
    )


@query(
    "n3_short_text",
    "doc_id l, short s",
    r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 250) AS short FROM documents",
)
def n3(m):
    return m.stored("documents").select("doc_id", s.short(F.col("text"), 250).alias("short"))


@query(
    "n4_money",
    "seq l, amount m, error s",
    f"""SELECT seq, {money_value('amount')} AS amount, CASE WHEN coalesce({kind('amount')}, 'NULL') NOT IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE')
        THEN 'amount_invalid' END AS error FROM raw_transactions""",
)
def n4(m):
    amount = s.opened("amount")
    return attributes(m.raw_transactions(), "amount").select(
        "seq", s.money(amount).alias("amount"), s.money_error(amount, "amount", blank_ok=False).alias("error")
    )


@query(
    "n5_date",
    "seq l, day d, error s",
    f"SELECT seq, {date_value('date_payment')} AS day, {date_error('date_payment')} AS error FROM raw_transactions",
)
def n5(m):
    value = s.opened("date_payment")
    return attributes(m.raw_transactions(), "date_payment").select(
        "seq", s.iso_date(value).alias("day"), s.iso_date_error(value, "date_payment").alias("error")
    )


@query(
    "n6_datetime",
    "seq l, moment t, error s",
    f"SELECT seq, {moment_value('date')} AS moment, {moment_error('date', True)} AS error FROM raw_movements",
)
def n6(m):
    value = s.opened("date")
    return attributes(m.raw_movements(), "date").select(
        "seq", s.iso_timestamp(value).alias("moment"), s.iso_timestamp_error(value, "date", required=True).alias("error")
    )


CUSTOMER_ERRORS = ", ".join(
    [id_error("id", True), text_error("name"), text_error("identification"), text_error("origin"), moment_error("created_at")]
)


@query(
    "n7_normalize_customers",
    "seq l, external_id n, name s, origin s, source_created_at t, errors s",
    f"""SELECT seq, {id_value('id')} AS external_id, {text_value('name')} AS name, {text_value('origin')} AS origin,
        {moment_value('created_at')} AS source_created_at, concat_ws(',', {CUSTOMER_ERRORS}) AS errors FROM raw_customers""",
)
def n7(m):
    return normalize.normalize_customers(records(m.raw_customers())).withColumn("errors", F.array_join("errors", ","))


CASE_ERRORS = ", ".join(
    [
        id_error("id", True),
        f"CASE WHEN NOT {blank('fees_expec')} AND {kind('fees_expec')} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'fees_expec_invalid' END",
        f"CASE WHEN {kind('customers')} <> 'ARRAY' THEN 'customers_invalid' END",
    ]
)

@query(
    "n8_normalize_cases",
    "seq l, external_id l, folder s, stage_id n, responsible_id n, process_date d, step_label s, fees_expected m, customers s, names s, errors s",
    f"""SELECT seq, {id_value('id')} AS external_id, {text_value('folder')} AS folder, {id_value('stages_id')} AS stage_id,
        {id_value('responsible_id')} AS responsible_id, {date_value('process_date')} AS process_date, 'Em andamento' AS step_label,
        {money_value('fees_expec')} AS fees_expected,
        CASE WHEN {kind('customers')} = 'ARRAY' THEN concat({id_value('customers[0].customer_id')}, ',', {id_value('customers[1].customer_id')}) ELSE '' END AS customers,
        CASE WHEN {kind('customers')} = 'ARRAY' THEN concat({id_value('customers[0].customer_id')}, '=', {text('customers[3].name')}, ',',
          {id_value('customers[1].customer_id')}, '=-') ELSE '' END AS names,
        concat_ws(',', {CASE_ERRORS}) AS errors FROM raw_cases""",
)
def n8(m):
    shown = F.transform(
        F.map_entries("customer_names"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("-")))
    )
    return (
        normalize.normalize_cases(records(m.raw_cases()))
        .withColumn("errors", F.array_join("errors", ","))
        .withColumn("customers", F.array_join(F.col("customer_ids").cast("array<string>"), ","))
        .withColumn("names", F.array_join(shown, ","))
    )


TRANSACTION_ERRORS = ", ".join(
    [
        id_error("id", True),
        id_error("lawsuit_id"),
        f"CASE WHEN coalesce({kind('amount')}, 'NULL') NOT IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN 'amount_invalid' END",
        date_error("date_due"),
        date_error("date_payment"),
        f"CASE WHEN coalesce({kind('is_internal')}, 'NULL') NOT IN ('NULL', 'BOOLEAN') THEN 'is_internal_invalid' END",
    ]
)


@query(
    "n9_normalize_transactions",
    "seq l, external_id l, case_external_id n, amount m, amount_status s, date_due d, date_payment d, errors s",
    f"""SELECT seq, {id_value('id')} AS external_id, {id_value('lawsuit_id')} AS case_external_id, {money_value('amount')} AS amount,
        CASE WHEN {money_value('amount')} IS NULL THEN 'not_provided' ELSE 'available' END AS amount_status,
        {date_value('date_due')} AS date_due, {date_value('date_payment')} AS date_payment,
        concat_ws(',', {TRANSACTION_ERRORS}) AS errors FROM raw_transactions""",
)
def n9(m):
    return normalize.normalize_transactions(records(m.raw_transactions())).withColumn("errors", F.array_join("errors", ","))


MOVEMENT_ERRORS = ", ".join([id_error("lawsuit_id", True), moment_error("date", True), text_error("title")])
FINGERPRINT = f"""sha256(concat('["', {id_value('lawsuit_id')}, '","', strftime({moment_value('date')}, '%Y-%m-%dT%H:%M:%S.%f'), '",',
        CASE WHEN {text_value('title')} IS NULL THEN 'null' ELSE concat('"', {text_value('title')}, '"') END, ']'))"""


@query(
    "n10_normalize_movements",
    "seq l, case_external_id n, occurred_at t, title s, fingerprint s, errors s",
    f"""SELECT * REPLACE (CASE WHEN errors = '' THEN fingerprint END AS fingerprint) FROM (SELECT seq, {id_value('lawsuit_id')} AS case_external_id,
        {moment_value('date')} AS occurred_at, {text_value('title')} AS title, {FINGERPRINT} AS fingerprint,
        concat_ws(',', {MOVEMENT_ERRORS}) AS errors FROM raw_movements)""",
)
def n10(m):
    """The fingerprint is shown for accepted rows."""
    moved = normalize.normalize_movements(records(m.raw_movements())).withColumn("errors", F.array_join("errors", ","))
    return moved.withColumn("fingerprint", F.when(F.col("errors") == "", F.col("fingerprint")))


@query(
    "n11_split_rejects",
    "side s, seq l, errors s",
    f"""SELECT CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS side, seq, errors
        FROM (SELECT seq, concat_ws(',', {CUSTOMER_ERRORS}) AS errors FROM raw_customers)""",
)
def n11(m):
    sides = normalize.split_rejects(normalize.normalize_customers(records(m.raw_customers())))
    return sides.select("side", "seq", F.array_join("errors", ",").alias("errors"))


@query(
    "n12_identifier_fallback",
    "seq l, external_id l, identifiers_only b, folder s, step_label s, customers s, errors s",
    f"""SELECT seq, {id_value('id')} AS external_id, errors <> '' AS identifiers_only, {text_value('folder')} AS folder,
        CASE WHEN errors = '' THEN 'Em andamento' END AS step_label,
        CASE WHEN {kind('customers')} = 'ARRAY' THEN concat({id_value('customers[0].customer_id')}, ',', {id_value('customers[1].customer_id')}) ELSE '' END AS customers,
        '' AS errors FROM (SELECT *, concat_ws(',', {CASE_ERRORS}) AS errors FROM raw_cases)""",
)
def n12(m):
    return (
        normalize.with_identifier_fallback(records(m.raw_cases()))
        .withColumn("errors", F.array_join("errors", ","))
        .withColumn("customers", F.array_join(F.col("customer_ids").cast("array<string>"), ","))
    )


@query(
    "n13_row_digest",
    "customer_id l, digest s",
    """SELECT customer_id, sha256(concat('{"customer_id":', customer_id, ',"name":"', name, '","origin":',
       CASE WHEN origin IS NULL THEN 'null' ELSE concat('"', origin, '"') END, '}')) AS digest FROM customers""",
)
def n13(m):
    return m.customers().withColumn("digest", s.row_digest("name", "customer_id", "origin"))


@query(
    "n14_case_number",
    "case_id l, number s",
    r"""SELECT case_id, CASE WHEN regexp_matches(trim(process_number), '^[0-9]{7}[-.]?[0-9]{2}[.]?[0-9]{4}[.]?[0-9][.]?[0-9]{2}[.]?[0-9]{4}$')
        THEN regexp_replace(process_number, '[^0-9]', '', 'g') END AS number FROM cases""",
)
def n14(m):
    return m.cases().withColumn("number", s.case_number(F.col("process_number")))


@query(
    "n15_folder_key",
    "doc_id l, digest s",
    r"SELECT doc_id, sha256(nfc_normalize(regexp_replace(replace(replace(text, 'é', 'e' || chr(769)), 'ç', 'c' || chr(807)), '^\s+|\s+$', '', 'g'))) AS digest FROM documents",
)
def n15(m):
    """Document texts with accents taken apart; the key must put them together again."""
    apart = F.regexp_replace(F.regexp_replace("text", "é", "é"), "ç", "ç")
    return m.stored("documents").select("doc_id", F.sha2(s.folder_key(apart), 256).alias("digest"))


@query(
    "n16_label",
    "case_id l, step s, stage s",
    r"""SELECT case_id, trim(regexp_replace(upper(step), '\s+', ' ', 'g')) AS step, trim(regexp_replace(upper(stage), '\s+', ' ', 'g')) AS stage
        FROM cases""",
)
def n16(m):
    return m.cases().select("case_id", s.label(F.col("step")).alias("step"), s.label(F.col("stage")).alias("stage"))


@query(
    "n17_deterministic_id",
    "item_id s, uuid s",
    """SELECT item_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
       translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS uuid
       FROM (SELECT item_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(item_id || ':v1')) AS h FROM items)""",
)
def n17(m):
    return m.items().select("item_id", s.deterministic_id(F.concat("item_id", F.lit(":v1"))).alias("uuid"))


@query(
    "n18_formats",
    "entry_id l, money s, percent s, day s, number s",
    r"""SELECT entry_id, CASE WHEN amount < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{:,.2f}', abs(amount)), ',.', '.,') AS money,
        replace(regexp_replace(CAST(round(CAST(amount AS DECIMAL(30,5)) * 0.001, 2) AS DECIMAL(18,2))::VARCHAR, '\.?0+$', ''), '.', ',') || '%' AS percent,
        coalesce(strftime(date_payment, '%d/%m/%Y'), '—') AS day,
        regexp_replace(lpad(case_id::VARCHAR, 20, '0'), '^([0-9]{7})([0-9]{2})([0-9]{4})([0-9])([0-9]{2})([0-9]{4})$', '\1-\2.\3.\4.\5.\6') AS number
        FROM (SELECT * REPLACE (CASE WHEN entry_type = 'expense' THEN -amount ELSE amount END AS amount) FROM transactions)""",
)
def n18(m):
    signed = F.when(F.col("entry_type") == "expense", -F.col("amount")).otherwise(F.col("amount"))
    return (
        m.transactions()
        .withColumn("amount", signed)
        .select(
            "entry_id",
            formats.format_money(F.col("amount")).alias("money"),
            formats.format_percent((F.col("amount") / 1000).cast("decimal(18,2)")).alias("percent"),
            formats.format_date(F.col("date_payment")).alias("day"),
            formats.format_case_number(F.lpad(F.col("case_id").cast("string"), 20, "0")).alias("number"),
        )
    )


@query(
    "n18_local_times",
    "event_id l, day s, moment s",
    """SELECT event_id, strftime(local, '%d/%m/%Y') AS day, strftime(local, '%d/%m/%Y %H:%M') AS moment
       FROM (SELECT event_id, timezone('America/Sao_Paulo', timezone('UTC', ts)) AS local FROM events)""",
)
def n18_local(m):
    return m.stored("events").select(
        "event_id",
        formats.format_local_date(F.col("ts")).alias("day"),
        formats.format_local_datetime(F.col("ts")).alias("moment"),
    )


@query(
    "n19_month_period",
    "case_id l, period_start d, period_end d",
    """SELECT case_id, CASE WHEN opened_on < DATE '1998-06-01' OR date_trunc('month', opened_on) = DATE '1998-06-01' THEN date_trunc('month', opened_on)::DATE END AS period_start,
       CASE WHEN date_trunc('month', opened_on) <= DATE '1998-06-15' THEN least(last_day(opened_on), DATE '1998-06-15') END AS period_end FROM cases""",
)
def n19(m):
    period = s.month_period(F.date_format("opened_on", "yyyy-MM"), F.lit("1998-06-15").cast("date"))
    return m.cases().select("case_id", period.alias("p")).select("case_id", "p.*")


@query(
    "n20_recent_months",
    "day d, month s, back l",
    """SELECT day, strftime(date_trunc('month', day) - to_months(i), '%Y-%m') AS month, i AS back
       FROM (SELECT DISTINCT opened_on AS day FROM cases), (SELECT unnest(range(12))::INT AS i)""",
)
def n20(m):
    """The month list as seen on every day a case was opened."""
    days = m.cases().select(F.col("opened_on").alias("day")).distinct()
    return days.select("day", F.posexplode(s.recent_months(F.col("day"))).alias("back", "month"))


@query(
    "n21_months_before",
    "event_id l, moment t",
    "SELECT event_id, ts - INTERVAL 23 MONTH AS moment FROM events",
)
def n21(m):
    return m.stored("events").select("event_id", s.months_before(F.col("ts"), 23).alias("moment"))


@query(
    "n22_opaque_digest",
    "doc_id l, digest s",
    r"""SELECT doc_id, CASE WHEN folded <> '' THEN sha256('salt' || folded) END AS digest
        FROM (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS folded FROM documents)""",
)
def n22(m):
    return m.stored("documents").select("doc_id", s.opaque_digest(F.col("text"), "salt").alias("digest"))


@query(
    "n23_technical_id",
    "seq l, id s",
    f"SELECT seq, CASE WHEN {kind('id')} IN ('UBIGINT', 'BIGINT', 'VARCHAR') THEN nullif(trim({text('id')}), '') END AS id FROM raw_customers",
)
def n23(m):
    return attributes(m.raw_customers(), "id").select("seq", s.technical_id(s.opened("id")).alias("id"))


@query(
    "n24_parse_percent",
    "entry_id l, percent m",
    """SELECT entry_id, CASE WHEN v BETWEEN 0 AND 100 THEN CAST(round_even(v, 2) AS DECIMAL(5,2)) END AS percent FROM (SELECT entry_id,
       CAST(round(CAST(amount AS DECIMAL(30,5)) * 0.002, 3) AS DECIMAL(18,3)) * CASE WHEN entry_type = 'expense' THEN -1 ELSE 1 END AS v FROM transactions)""",
)
def n24(m):
    """Amounts written as percent texts with a comma and three places."""
    sign = F.when(F.col("entry_type") == "expense", "-").otherwise(" ")
    number = F.translate((F.col("amount") / 500).cast("decimal(18,3)").cast("string"), ".", ",")
    written = F.concat(sign, number, F.lit("%"))
    return m.transactions().select("entry_id", s.parse_percent(written).alias("percent"))


@query(
    "n25_local_day_key",
    "event_id l, key s",
    "SELECT event_id, strftime(timezone('America/Sao_Paulo', timezone('UTC', ts)), 'daily-%Y-%m-%d') AS key FROM events",
)
def n25(m):
    return m.stored("events").select("event_id", s.local_day_key(F.col("ts")).alias("key"))


@query(
    "n26_display_name",
    "conv_id l, turn l, name s",
    r"""SELECT conv_id, turn, CASE WHEN length(name) BETWEEN 2 AND 120 AND NOT regexp_matches(name, '\p{C}') THEN name END AS name
        FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS name FROM conversations)""",
)
def n26(m):
    return m.stored("conversations").select("conv_id", "turn", s.valid_display_name(F.col("text")).alias("name"))


# -- ingest counters --------------------------------------------------------------------------


@query(
    "a5_ingest_counters",
    "pages l, total_reported l, accepted l, duplicates l, rejected l, balanced b",
    f"""WITH n AS (SELECT *, concat_ws(',', {MOVEMENT_ERRORS}) AS errors, {FINGERPRINT} AS fp FROM raw_movements)
        SELECT (SELECT count(DISTINCT seq // {PAGE_SIZE}) FROM n) AS pages, (SELECT count(*) FROM n) AS total_reported,
          (SELECT count(DISTINCT fp) FROM n WHERE errors = '') AS accepted,
          (SELECT count(*) - count(DISTINCT fp) FROM n WHERE errors = '') AS duplicates,
          (SELECT count(*) FROM n WHERE errors <> '') + (SELECT count(*) - count(DISTINCT fp) FROM n WHERE errors = '') AS rejected,
          TRUE AS balanced""",
)
def a5(m):
    scan = pages.parse_pages(landed(m.raw_movements(), "last_movements"))
    return normalize.ingest_counters(scan, normalize.normalize_movements(pages.page_records(scan)), "fingerprint")


@query(
    "a6_candidate_coverage",
    "resource s, total l, duplicate_ids l, direct_partner_fields l, with_origin l, without_origin l, with_folder l, with_responsible l, "
    "one_origin l, many_origins l, distinct_origins l",
    f"""SELECT 'customers' AS resource, count(*) AS total, count(*) - count(DISTINCT {text('id')}) AS duplicate_ids, 0 AS direct_partner_fields,
          count({text('origin')}) AS with_origin, count(*) - count({text('origin')}) AS without_origin, 0 AS with_folder, 0 AS with_responsible,
          count({text('origin')}) AS one_origin, 0 AS many_origins, count(DISTINCT {text('origin')}) AS distinct_origins FROM raw_customers
        UNION ALL SELECT 'lawsuits', count(*), 0, 0, count_if({kind('customers')} = 'ARRAY'), count_if({kind('customers')} <> 'ARRAY'),
          count_if({text('folder')} <> ''), count_if({kind('responsible_id')} <> 'NULL'), 0, count_if({kind('customers')} = 'ARRAY'),
          (SELECT 1 + count(DISTINCT {text('stage')}) FROM raw_cases WHERE {kind('customers')} = 'ARRAY') FROM raw_cases""",
)
def a6(m):
    customers = normalize.candidate_coverage(records(m.raw_customers()), "salt", False)
    cases = normalize.candidate_coverage(records(m.raw_cases()), "salt", True)
    return customers.withColumn("resource", F.lit("customers")).unionByName(cases.withColumn("resource", F.lit("lawsuits")))


@query(
    "a6_missing_relationships",
    "customer_references l, missing_customers l",
    f"""WITH refs AS (SELECT {text('customers[0].customer_id')} AS id, 2 AS n FROM raw_cases WHERE {kind('customers')} = 'ARRAY'
          UNION ALL SELECT {text('customers[1].customer_id')}, 1 FROM raw_cases WHERE {kind('customers')} = 'ARRAY'
          UNION ALL SELECT '0', 1 FROM raw_cases WHERE {kind('customers')} = 'ARRAY')
        SELECT sum(n) AS customer_references, count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT {text('id')} FROM raw_customers)) AS missing_customers FROM refs""",
)
def a6_missing(m):
    return normalize.missing_relationships(records(m.raw_cases()), records(m.raw_customers()))


@query(
    "l1_effective_on_day_range",
    "link_id l, day d",
    """SELECT link_id, day FROM links, (SELECT DATE '1995-06-30' AS day UNION ALL SELECT DATE '1999-12-31')
       WHERE status = 'active' AND valid_from <= day AND (valid_to IS NULL OR day <= valid_to)""",
)
def l1_days(m):
    """The filter on two other days."""
    days = ("1995-06-30", "1999-12-31")
    frames = [effective_on(m.links(), d).select("link_id", F.lit(d).cast("date").alias("day")) for d in days]
    return frames[0].unionByName(frames[1])
