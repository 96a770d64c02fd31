"""Row selection on server and address snapshots, and comparison of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import (
    legacy_server_status, local_ip, name_has_prefix, public_ip, server_status,
)


def servers_with_pattern(servers: DataFrame, pattern: str, ignore=()) -> DataFrame:
    """Servers whose name starts with the pattern, minus the named ones."""
    kept = servers.filter(name_has_prefix(F.col("name"), pattern))
    return kept.filter(~F.col("name").isin(*ignore)) if ignore else kept


def unattached(ips: DataFrame) -> DataFrame:
    return ips.filter(F.col("instance_id").isNull())


def except_keys(df: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the ignore table; an empty table ignores nothing."""
    return df.join(ignored.select(key), key, "left_anti").select(*df.columns)


def existing(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``names`` that exist in ``known``."""
    return names.join(known.select(key), key, "left_semi").select(*names.columns)


def orphaned_ips(earlier: DataFrame, later: DataFrame, ignored: DataFrame) -> DataFrame:
    """Later rows of addresses unattached in both snapshots and not ignored."""
    both = existing(unattached(later), unattached(earlier), "ip")
    return except_keys(both, ignored, "ip")


def snapshot_delta(before: DataFrame, after: DataFrame, expected: int = 1) -> DataFrame:
    """Change of each counter between two snapshots and whether it is the expected one."""
    joined = before.select("name", F.col("value").alias("before_value")).join(
        after.select("name", F.col("value").alias("after_value")), "name", "full")
    delta = F.col("after_value") - F.col("before_value")
    return joined.select("name", "before_value", "after_value", delta.alias("delta"),
                         F.coalesce(delta == expected, F.lit(False)).cast("int").alias("as_expected"))


def first_match(images: DataFrame, needles: list[str]) -> DataFrame:
    """For each needle the first row, by name and id, that holds it in its name or id.

    The needles are parameters of the call, so each row is tested against them in place and a
    minimum per needle is combined on the map side; no pair of tables is joined.
    """
    found = F.filter(
        F.array(*[F.lit(n) for n in needles]),
        lambda n: F.contains(F.col("name"), n) | F.contains(F.col("id"), n))
    hits = images.select(F.explode(found).alias("needle"), F.struct("name", "id").alias("hit"))
    first = hits.groupBy("needle").agg(F.min("hit").alias("hit"))
    return first.select("needle", "hit.name", "hit.id")


# Rows whose pieces one task makes; some thousand bytes each are held at once.
INDEX_ROWS = 40_000


def first_match_of(images: DataFrame, needles: DataFrame) -> DataFrame:
    """``first_match`` for a table of needles of any size, column ``needle``.

    Names and ids are indexed by their character trigrams. A needle is looked up by the trigram it
    holds that fewest of them hold, and only rows with that trigram are tested, by an equality join.
    Needles of one or two characters are looked up among the first rows per such piece, needles
    without characters get the first row of all. NULL needles match nothing.

    Equal rows are taken once, before they are cut into pieces, and spread over tasks of about
    ``INDEX_ROWS`` rows by a count, so the pieces a task holds do not grow with the table.
    """
    asked = needles.select("needle").filter("needle IS NOT NULL").distinct()
    hit = F.struct("name", "id").alias("hit")
    tasks = max(1, -(-images.count() // INDEX_ROWS))
    rows = images.select("name", "id").distinct().repartition(tasks, "name", "id")

    def index(size: int) -> DataFrame:
        pieces = F.array_union(_pieces(F.col("name"), size), _pieces(F.col("id"), size))
        return rows.select(hit, F.explode(pieces).alias("piece"))

    # The rarest trigram of each needle; one that no row holds has no match at all.
    long = asked.filter(F.length("needle") >= 3)
    held = index(3)
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    probes = (long.select("needle", F.explode(_pieces(F.col("needle"), 3)).alias("piece"))
              .join(counts, "piece", "left")
              .groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))
                                     .alias("p")).filter("p.n > 0"))
    holds = lambda c: F.coalesce(F.contains(F.col(f"hit.{c}"), F.col("needle")), F.lit(False))
    found = (probes.select("needle", F.col("p.piece").alias("piece")).join(held, "piece")
             .filter(holds("name") | holds("id"))
             .groupBy("needle").agg(F.min("hit").alias("hit")))

    for size in (1, 2):
        firsts = index(size).groupBy(F.col("piece").alias("needle")).agg(F.min("hit").alias("hit"))
        found = found.union(asked.filter(F.length("needle") == size).join(firsts, "needle")
                            .select("needle", "hit"))
    first = images.filter("name IS NOT NULL OR id IS NOT NULL").agg(
        F.min(F.struct("name", "id")).alias("hit")).scalar()
    whole = asked.filter(F.length("needle") == 0).select("needle", first.alias("hit")).filter(
        "hit IS NOT NULL")
    return found.union(whole).select("needle", "hit.name", "hit.id")


def _pieces(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def add_if_absent(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``known`` plus one row for each new key it does not hold."""
    rest = [c for c in known.columns if c != key]
    per_key = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(
        key, *[F.col(f"row.{c}").alias(c) for c in rest])
    absent = per_key.join(known.select(key), key, "left_anti")
    return known.select(*known.columns).unionByName(absent)


def server_addresses(servers: DataFrame) -> DataFrame:
    """Local, public and floating address of each server."""
    public = public_ip(F.col("addresses"))
    return servers.select("id", local_ip(F.col("addresses")).alias("ip_local"),
                          public.alias("ip_public"), public.alias("ip_floating"))


def server_states(servers: DataFrame, initial: str = "BUILD") -> DataFrame:
    """Normalised status of each server in both layouts."""
    first: Column = F.lit(initial)
    return servers.select(
        "id",
        server_status(F.col("vm_state"), F.col("task_state"), first).alias("status"),
        legacy_server_status(F.col("legacy_status"), first).alias("legacy_status"))
