"""Scrubs, upserts, referential checks and cascading deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scrub:
    """Set ``column`` to ``value`` where any of the fragments occurs in ``source``."""

    column: str
    value: str
    source: str
    fragments: tuple[str, ...]

    def applies(self) -> Column:
        hit = F.col(self.source).contains(self.fragments[0])
        for fragment in self.fragments[1:]:
            hit = hit | F.col(self.source).contains(fragment)
        return hit


# Text fragments and the error type they stand for, in the order applied.
ERROR_SCRUBS = [
    Scrub("error_type",
          "The server has either erred or is incapable of performing the requested operation. "
          "(HTTP 500)", "error_text",
          ("The server has either erred or is incapable of performing the requested operation. "
           "(HTTP 500)",)),
    Scrub("error_type", "SSH Failed: Permission denied (publickey)", "error_text",
          ("Permission denied (publickey)",)),
    Scrub("error_type", "(HTTP 413) Instance quota exceeded", "error_text",
          ("Instance quota exceeded",)),
    Scrub("error_type", "(HTTP 404) Resource Not Found", "error_text",
          ("The resource could not be found. (HTTP 404)",
           "Instance could not be found (HTTP 404)")),
    Scrub("error_type", "Test timed out", "error_text", ("Test timed out",)),
]


def scrub(df: DataFrame, rules: list[Scrub]) -> DataFrame:
    """Apply rules one after the other; a later rule overwrites an earlier one."""
    for rule in rules:
        df = df.withColumn(rule.column, F.when(rule.applies(), F.lit(rule.value))
                           .otherwise(F.col(rule.column)))
    return df


def scrub_environments(passes: DataFrame, by_region: dict[str, str],
                       blank: str | None = None) -> DataFrame:
    """Environment from the region where one is given, then a name for blank environments."""
    name = F.col("environ_name")
    for region, environ in by_region.items():
        name = F.when(F.col("region") == region, F.lit(environ)).otherwise(name)
    if blank is not None:
        name = F.when(name == "", F.lit(blank)).otherwise(name)
    return passes.withColumn("environ_name", name)


def scrub_hard_flag(results: DataFrame) -> DataFrame:
    """Clear the hard-error flag of tests without hard errors."""
    return results.withColumn("hard_errors_exist", F.when(
        F.col("hard_error_count") == 0, F.lit(0)).otherwise(F.col("hard_errors_exist")))


def upsert_pass_end(passes: DataFrame, updates: DataFrame) -> DataFrame:
    """Passes with end and total taken from the newest update of each id.

    Updates of unknown ids change nothing, as an UPDATE would. The newest update is found
    before the join with a combinable maximum, so many updates of one id do not meet there.
    """
    newest = updates.groupBy("test_pass_id").agg(
        F.max_by(F.struct("time_end", "time_total"), F.struct("version", "time_end", "time_total"))
        .alias("u"))
    joined = passes.join(newest, "test_pass_id", "left")
    changed = F.col("u").isNotNull()
    return joined.withColumns({
        "time_end": F.when(changed, F.col("u.time_end")).otherwise(F.col("time_end")),
        "time_total": F.when(changed, F.col("u.time_total")).otherwise(F.col("time_total")),
    }).select(*passes.columns)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is set but unknown to the parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    known = child.filter(F.col(child_key).isNotNull())
    return known.join(keys, child_key, "left_anti").select(*child.columns)


def orphan_counts(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphans per relation: (name, child, child key, parent, parent key).

    Child keys are counted per value first, so a hot key meets its parent once.
    """
    parts = []
    for name, child, child_key, parent, parent_key in checks:
        per_key = child.groupBy(child_key).agg(F.count("*").alias("n"))
        bad = orphans(per_key, child_key, parent, parent_key)
        parts.append(bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
                     .select(F.lit(name).alias("relation"), "orphans"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cascade_delete(passes: DataFrame, results: DataFrame, actions: DataFrame,
                   condition: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains of the three tables when the passes that satisfy a condition are deleted
    together with their tests and the actions of those."""
    gone_passes = passes.filter(condition).select("test_pass_id")
    gone_tests = results.join(gone_passes, "test_pass_id", "left_semi").select("test_id")
    return (
        passes.filter(~F.coalesce(condition, F.lit(False))),
        results.join(gone_passes, "test_pass_id", "left_anti").select(*results.columns),
        actions.join(gone_tests, "test_id", "left_anti").select(*actions.columns),
    )
