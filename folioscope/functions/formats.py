"""Display formats used in portfolio reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.scalars import BUSINESS_ZONE


def format_money(amount: Column) -> Column:
    """``-R$ 1.234,56``"""
    digits = F.translate(F.format_number(F.abs(amount), 2), ",.", ".,")
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(F.lit("")), F.lit("R$ "), digits)


def format_percent(value: Column) -> Column:
    """Shortest decimal form with a comma: ``12,5%``."""
    text = value.cast("string")
    bare = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.concat(F.translate(bare, ".", ","), F.lit("%"))


def format_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit("—"))


def format_local_date(moment: Column, zone: str = BUSINESS_ZONE) -> Column:
    return format_date(F.to_date(F.from_utc_timestamp(moment, zone)))


def format_local_datetime(moment: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(moment, zone), "dd/MM/yyyy HH:mm")


def format_case_number(number: Column) -> Column:
    """Masks twenty digits; other text is shown as it is."""
    masked = F.regexp_replace(
        number, r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", "$1-$2.$3.$4.$5.$6"
    )
    return F.when(F.length(number) == 20, masked).otherwise(number)
