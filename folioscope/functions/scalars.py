"""Column expressions for strict normalisation of source values.

Records arrive as VARIANT, so the JSON type of each value is still known; :func:`open_record`
turns it into a :class:`Raw` pair. Every reader of such a pair has a ``*_error`` twin that returns
a code when the value breaks the contract and null otherwise.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import small_methods

# Business zone, case-number shape, money scale.
BUSINESS_ZONE = "America/Sao_Paulo"
CASE_NUMBER_PATTERN = r"^\d{7}[-.]?\d{2}[.]?\d{4}[.]?\d[.]?\d{2}[.]?\d{4}$"
MONEY_TYPE = "decimal(18,2)"
NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"

#: White space at both ends; a run of it is looked at once, from its begin.
_EDGE_SPACE = r"(?U)^\s++|(?<!\s)\s++$"
_ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"
_ISO_OFFSET = r"[T ].*[+-]\d{2}:?\d{2}$"
#: Steps from the other ISO forms to the extended one with minutes and at most six fraction digits.
_ISO_FORMS = (
    (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"),
    (r"^(.{10}[T ]\d{2})(\d{2})(?=\d{2}([.,+-]|$))", "$1:$2:"),
    (r"^(.{10}[T ]\d{2})(\d{2})(?=$|[+-])", "$1:$2"),
    (r"^(.{10}[T ]\d{2})(?=$|[+-])", "$1:00"),
    (r"^(.{10}[T ]\d{2}:\d{2}:\d{2})[.,](\d{1,6})\d*", "$1.$2"),
    (r"^(.{10}[T ].*[+-]\d{2})$", "$1:00"),
)


def field(record: Column | str, path: str) -> Column:
    """One attribute of a VARIANT record, still a VARIANT."""
    return F.try_variant_get(record if isinstance(record, Column) else F.col(record), f"$.{path}", "variant")


def codes(*candidates: Column) -> Column:
    """Array of the non-null codes; built from text, which stays inside generated code."""
    joined = F.concat_ws(",", *candidates)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


class Raw(NamedTuple):
    """A source value: the first character of its JSON form, which tells the type, and its text."""

    mark: Column
    text: Column

    def absent(self) -> Column:
        return F.coalesce(self.mark == ord("n"), F.lit(True))

    def is_string(self) -> Column:
        return F.coalesce(self.mark == ord('"'), F.lit(False))

    def is_boolean(self) -> Column:
        return F.coalesce(self.mark.isin(ord("t"), ord("f")), F.lit(False))

    def is_number(self) -> Column:
        digit_or_minus = self.mark.between(ord("0"), ord("9")) | (self.mark == ord("-"))
        return F.coalesce(digit_or_minus, F.lit(False))

    def integer(self) -> Column:
        """The value of a whole JSON number; 1.0 and 1e3 are not whole by form."""
        return F.when(self.is_number(), self.text.try_cast("bigint"))


def open_record(df: DataFrame, names: Sequence[str], record: str = "record", extra: Sequence[Column] = ()) -> DataFrame:
    """Replaces a VARIANT record by ``_<name>_mark`` and ``_<name>_text`` columns.

    A record is walked twice for all its attributes, once for their values and once for their texts, and not once
    for each of them. The steps stay apart in the plan, so each is done once per row however often the normalising
    expressions use it.
    """
    small_methods(df.sparkSession)
    kept = [c for c in df.columns if c != record]
    if not names:
        return df.select(*kept, *extra)
    values, texts = (
        F.try_variant_get(F.col(record), "$", f"struct<{', '.join(f'`{n}` {kind}' for n in names)}>") for kind in ("variant", "string")
    )
    walked = df.select(*kept, *extra, values.alias("_values"), texts.alias("_texts"))
    forms = walked.withColumns({f"_{n}_form": F.to_json(F.col("_values")[n]) for n in names}).drop("_values")
    marks = {f"_{n}_mark": F.ascii(f"_{n}_form") for n in names}
    # The JSON form of a string has quotes and escapes, its text hasn't.
    plain = {f"_{n}_text": F.when(marks[f"_{n}_mark"] == ord('"'), F.col("_texts")[n]).otherwise(F.col(f"_{n}_form")) for n in names}
    return forms.withColumns(marks | plain).drop("_texts", *[f"_{n}_form" for n in names])


def opened(name: str) -> Raw:
    """The value of an attribute that :func:`open_record` has looked up."""
    return Raw(F.col(f"_{name}_mark"), F.col(f"_{name}_text"))


def open_list(entries: Column, names: Sequence[str]) -> Column:
    """Opens every entry of a VARIANT array: struct(is_object, <name> struct(mark, text), ...)."""
    looked_up = F.transform(
        entries,
        lambda r: F.struct(
            is_object(r).alias("is_object"),
            *[F.to_json(field(r, n)).alias(f"{n}_form") for n in names],
            *[F.try_variant_get(r, f"$.{n}", "string").alias(f"{n}_text") for n in names],
        ),
    )
    return F.transform(
        looked_up,
        lambda e: F.struct(
            e["is_object"].alias("is_object"),
            *[F.struct(F.ascii(e[f"{n}_form"]).alias("mark"), e[f"{n}_text"].alias("text")).alias(n) for n in names],
        ),
    )


def entry_value(entry: Column, name: str) -> Raw:
    return Raw(entry[name]["mark"], entry[name]["text"])


def is_object(value: Column) -> Column:
    """Is a VARIANT a JSON object?"""
    # An empty struct tells as much as a map and copies none of its values.
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def _is_blank(value: Raw) -> Column:
    """Missing, null or the empty string."""
    return value.absent() | (value.is_string() & (value.text == ""))


def _is_no_id(value: Raw) -> Column:
    """Values that mean "no identifier": blank, zero and false."""
    zero = value.is_number() & F.coalesce(value.text.try_cast("decimal(38,6)") == 0, F.lit(False))
    return _is_blank(value) | zero | (value.is_boolean() & (value.text == "false"))


def positive_id(value: Raw) -> Column:
    """Identifier as bigint; null when absent or malformed."""
    return F.when(value.integer() > 0, value.integer())


def positive_id_error(value: Raw, name: str, required: bool = False) -> Column:
    missing = F.lit(f"{name}_missing") if required else F.lit(None).cast("string")
    fine = positive_id(value).isNotNull()
    return F.when(~fine & _is_no_id(value), missing).when(~fine, F.lit(f"{name}_invalid"))


def text_or_null(value: Raw) -> Column:
    """Text as given (no trimming); the empty string means absent."""
    return F.when(value.is_string() & (value.text != ""), value.text)


def text_error(value: Raw, name: str) -> Column:
    return F.when(~value.absent() & ~value.is_string(), F.lit(f"{name}_invalid"))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one blank; edges are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def short(text: Column, limit: int = 250) -> Column:
    """Collapsed text cut to ``limit`` characters."""
    return F.substring(collapse(text), 1, limit)


def short_text(value: Raw, limit: int = 250) -> Column:
    return short(text_or_null(value), limit)


def money(value: Raw) -> Column:
    """Exact decimal from a JSON number; strings and booleans are not money."""
    return F.when(value.is_number(), value.text.try_cast(MONEY_TYPE))


def money_error(value: Raw, name: str, blank_ok: bool = True) -> Column:
    fine = _is_blank(value) if blank_ok else value.absent()
    return F.when(~fine & money(value).isNull(), F.lit(f"{name}_invalid"))


def iso_date_text(text: Column) -> Column:
    """The first ten characters as an ISO day."""
    day = F.substring(text, 1, 10)
    dashed = (F.length(day) == 10) & day.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(dashed, day.try_cast("date")).when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd"))


def iso_date(value: Raw) -> Column:
    return F.when(value.is_string(), iso_date_text(value.text))


def iso_date_error(value: Raw, name: str) -> Column:
    return F.when(~_is_blank(value) & iso_date(value).isNull(), F.lit(f"{name}_invalid"))


def iso_timestamp_text(text: Column, zone: str = BUSINESS_ZONE) -> Column:
    """ISO instant, basic or extended; a value without offset is local to ``zone`` whatever the session zone.

    Digits beyond the microsecond are cut off.
    """
    plain = F.regexp_replace(text, "Z", "+00:00")
    irregular = plain
    for form, extended in _ISO_FORMS:
        irregular = F.regexp_replace(irregular, form, extended)
    # Most values are extended already and skip the steps.
    plain = F.when(plain.rlike(_ISO_MOMENT), plain).otherwise(irregular)
    plain = F.regexp_replace(plain, r"^(.{10}[T ]\d{2}:\d{2})([+-]|$)", "$1:00$2")
    local = F.when(F.length(plain) == 10, F.concat(plain, F.lit(" 00:00:00"))).otherwise(plain)
    full = F.when(plain.rlike(_ISO_OFFSET), plain).otherwise(F.concat(local, F.lit(f" {zone}")))
    return F.when(plain.rlike(_ISO_MOMENT), full.try_cast("timestamp"))


def iso_timestamp(value: Raw, zone: str = BUSINESS_ZONE) -> Column:
    return F.when(value.is_string(), iso_timestamp_text(value.text, zone))


def iso_timestamp_error(value: Raw, name: str, required: bool = False) -> Column:
    missing = F.lit(f"{name}_missing") if required else F.lit(None).cast("string")
    return F.when(_is_blank(value), missing).when(iso_timestamp(value).isNull(), F.lit(f"{name}_invalid"))


def flag(value: Raw) -> Column:
    return F.when(value.is_boolean(), value.text == "true")


def flag_error(value: Raw, name: str) -> Column:
    return F.when(~value.absent() & ~value.is_boolean(), F.lit(f"{name}_invalid"))


def technical_id(value: Raw) -> Column:
    """An integer or a non-blank string, as text."""
    return F.when(value.integer().isNotNull(), value.text).when(
        value.is_string(), F.nullif(edge_trim(value.text), F.lit(""))
    )


def edge_trim(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def case_number(text: Column) -> Column:
    """Digits of a complete case number; anything else is null, never repaired."""
    trimmed = edge_trim(text)
    return F.when(trimmed.rlike(CASE_NUMBER_PATTERN), F.regexp_replace(trimmed, r"\D", ""))


@functools.cache
def _nfc():
    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return nfc


def folder_key(text: Column) -> Column:
    """Edge-trimmed NFC text, empty means absent. ASCII is in that form already and stays in the JVM."""
    trimmed = edge_trim(text)
    other = trimmed.rlike(r"[^\x00-\x7F]")
    return F.nullif(F.when(other, _nfc()(F.when(other, trimmed))).otherwise(trimmed), F.lit(""))


def label(text: Column) -> Column:
    """Upper-case label with collapsed white space; absent is the empty label."""
    return collapse(F.upper(F.coalesce(text, F.lit(""))))


def row_digest(*names: str) -> Column:
    """SHA-256 over the named fields in name order; a null field still counts."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def deterministic_id(name: Column) -> Column:
    """Version 5 UUID of ``name`` in the URL namespace."""
    raw = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL_HEX)), F.encode(name, "UTF-8")))
    # The two high bits of the variant digit are fixed to binary 10.
    variant = F.translate(F.substring(raw, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(raw, 1, 8),
        F.substring(raw, 9, 4),
        F.concat(F.lit("5"), F.substring(raw, 14, 3)),
        F.concat(variant, F.substring(raw, 18, 3)),
        F.substring(raw, 21, 12),
    )


def month_start(text: Column) -> Column:
    return F.when(
        text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")
    )


def month_period(text: Column, today: Column) -> Column:
    """struct(period_start, period_end) of a month; the running month ends today, a future one is null."""
    start = month_start(text)
    return F.when(
        start <= today,
        F.struct(start.alias("period_start"), F.least(F.last_day(start), today).alias("period_end")),
    )


def recent_months(today: Column, count: int = 12) -> Column:
    """Array of the last ``count`` months ('yyyy-MM'), newest first."""
    first = F.trunc(today, "month")
    spine = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(spine, lambda back: F.date_format(F.add_months(first, -back), "yyyy-MM"))


def months_before(moment: Column, months: int) -> Column:
    """Same time of day some months earlier; the day is clamped to the month's end."""
    day = F.add_months(F.to_date(moment), -months)
    micros = F.unix_micros(moment) - F.unix_micros(F.to_date(moment).cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros)


def opaque_digest(text: Column, salt: str) -> Column:
    """Salted digest of trimmed, case-folded text; blank text has none."""
    folded = F.lower(edge_trim(text))
    return F.when(folded != "", F.sha2(F.concat(F.lit(salt), folded), 256))


def parse_percent(text: Column) -> Column:
    """0..100 with two places, ties to even; null when it is not such a number."""
    number = F.translate(edge_trim(text), ",%", ".")
    value = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), number.try_cast("decimal(38,12)"))
    return F.when(value.between(0, 100), F.bround(value, 2).cast("decimal(5,2)"))


def local_day(moment: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def local_day_key(moment: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.concat(F.lit("daily-"), F.date_format(local_day(moment, zone), "yyyy-MM-dd"))


def valid_display_name(text: Column, longest: int = 120) -> Column:
    """The collapsed name when it is 2..``longest`` printable characters, else null."""
    name = collapse(text)
    fine = F.length(name).between(2, longest) & ~name.rlike(r"\p{C}")
    return F.when(fine, name)
