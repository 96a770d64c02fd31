"""Identity join behind the trust list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import trusted_line


def identities(external_ids: DataFrame, accounts: DataFrame) -> DataFrame:
    """Login and profile id of every active account.

    ``copies`` says how many rows the plain four-way left join gives for the combination:
    user names only multiply rows there, so they enter as a count per account.
    """
    by_kind = external_ids.groupBy("account_id", "external_id", "email_address").agg(
        F.count("*").alias("n"))
    like = F.col("external_id").like
    logins = by_kind.filter(like("%login.launchpad.net%")).select(
        "account_id", "email_address", F.col("external_id").alias("login_id"),
        F.col("n").alias("n_login"))
    profiles = by_kind.filter(like("%/launchpad.net%")).groupBy(
        "account_id", F.col("external_id").alias("profile_id")).agg(F.sum("n").alias("n_profile"))
    users = by_kind.filter(like("%username:%")).groupBy("account_id").agg(
        F.sum("n").alias("n_user"))
    active = accounts.filter(F.col("inactive") == "N").select("account_id", "full_name")
    one = F.lit(1)
    copies = (F.col("n_login") * F.coalesce("n_profile", one) * F.coalesce("n_user", one))
    return (
        logins.join(active, "account_id")
        .join(profiles, "account_id", "left")
        .join(users, "account_id", "left")
        .select("account_id", "email_address", "login_id", "profile_id", "full_name",
                copies.cast("bigint").alias("copies"))
    )


def identity_rows(external_ids: DataFrame, accounts: DataFrame, piece: int = 1024) -> DataFrame:
    """The rows of the plain four-way left join, repeated ones included.

    Each combination is joined once and then repeated ``copies`` times, in pieces, so that no
    array grows with the repetitions of one account beyond their number of pieces.
    """
    rows = identities(external_ids, accounts)
    names = [c for c in rows.columns if c != "copies"]
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / piece)))
    room = F.least(F.lit(piece), F.col("copies") - F.col("_piece") * piece)
    return rows.withColumn("_piece", pieces).select(
        *names, F.explode(F.sequence(F.lit(1), room.cast("int"))).alias("_copy")).select(*names)


def trusted_lines(external_ids: DataFrame, accounts: DataFrame) -> DataFrame:
    """Trust lines in order of the full name."""
    rows = identities(external_ids, accounts)
    line = trusted_line(F.col("login_id"), F.col("profile_id"), F.col("email_address"))
    return rows.select("full_name", line.alias("trust"), "copies").orderBy("full_name", "trust")
