"""Portal accounts: invitations and roles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.spread import first_rows


def valid_links(links: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Unused access links that have not expired."""
    at = F.lit(str(now)).cast("timestamp")
    return links.filter(F.col("used_at").isNull() & (F.col("expires_at") > at))


def account_list(users: DataFrame, links: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Users with their newest valid link, or the newest link when it ran out unused."""
    newest = [F.col("created_at").desc(), F.col("link_id").desc()]
    pending = first_rows(valid_links(links, now), ["user_id"], newest).select("user_id", F.col("link_id").alias("pending_link"))
    last = first_rows(links, ["user_id"], newest).filter("used_at is null").select("user_id", F.col("link_id").alias("_last"))
    lapsed = F.col("pending_link").isNull() & (F.col("status") == "active")
    return (
        users.join(pending, "user_id", "left")
        .join(last, "user_id", "left")
        .withColumn("expired_link", F.when(lapsed, F.col("_last")))
        .drop("_last")
    )


def user_roles(users: DataFrame, assignments: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct (user_id, role)."""
    return (
        assignments.join(roles.select("role_id", "role"), "role_id")
        .join(users.select("user_id"), "user_id", "left_semi")
        .select("user_id", "role")
        .distinct()
    )
