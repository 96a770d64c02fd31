"""Stored tables that change: copy-on-write of date partitions behind one manifest.

Partitions are days or, where days would be many and small, months or years, named by their first
day. Every commit writes new folders ``table/v=N/event_date=D`` for the days it touches and then one
manifest, number N, that lists for every table and day the versions it consists of. Readers follow
the newest manifest. Until it has its name nothing has changed, whatever a crash leaves behind; a
commit may cover several tables. Two writers that race for one number are told apart by the
manifest's name: the second one fails and nothing of it is seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.errors import normalize_no_error
from faultline.operators.maintenance import Scrub, scrub, upsert_pass_end
from faultline.sources.files import Folder
from faultline.sources.schemas import TABLES
from faultline.sources.storage import PARTITION_SOURCE, with_date

Days = dict[str, list[int]]
# Rows without a start are kept in the partition Spark gives to NULL.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class VersionedTables:
    """The tables of one root folder; ``grain`` is ``day``, ``month`` or ``year``."""

    def __init__(self, spark: SparkSession, root: str, grain: str = "day"):
        self.spark, self.root, self.grain = spark, root.rstrip("/"), grain
        self.manifests = Folder(spark, f"{self.root}/manifest")

    # -- reading -----------------------------------------------------------------------

    def state(self) -> tuple[int, dict[str, Days]]:
        """The newest version and its days by table."""
        numbers = self.manifests.numbers()
        return (numbers[-1], self.manifests.read(numbers[-1])) if numbers else (0, {})

    def read(self, table: str, days: list[str] | None = None, dated: bool = False) -> DataFrame:
        """The rows of a table, or of some of its days, as the newest manifest has them."""
        return self._read(self.state()[1].get(table, {}), table, days, dated)

    def _read(self, stored: Days, table: str, days: list[str] | None, dated: bool) -> DataFrame:
        paths = [f"{self.root}/{table}/v={v}/event_date={day}" for day, versions in stored.items()
                 if days is None or day in days for v in versions]
        names = [*TABLES[table].fieldNames(), *(["event_date"] if dated else [])]
        if not paths:
            return with_date(self.spark.createDataFrame([], TABLES[table]), table).select(*names)
        found = (self.spark.read.schema(TABLES[table]).option("basePath", f"{self.root}/{table}")
                 .parquet(*paths))
        return found.withColumn("event_date", F.col("event_date").cast("date")).select(*names)

    # -- writing -----------------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, version: int) -> list[str]:
        """Write rows below their days and give the days."""
        if table not in PARTITION_SOURCE:
            raise ValueError(f"{table} has no day to store it by")
        rows = df.select(*TABLES[table].fieldNames())
        if "error_type" in rows.columns:
            rows = rows.withColumn(
                "error_type", F.coalesce(normalize_no_error(F.col("error_type")), F.lit("")))
        path = f"{self.root}/{table}/v={version}"
        dated = with_date(rows, table)
        if self.grain != "day":
            dated = dated.withColumn("event_date", F.trunc("event_date", self.grain))
        (dated.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(path))
        names = self.manifests.folders(path)
        return [n.removeprefix("event_date=") for n in names if n.startswith("event_date=")]

    def append(self, **tables: DataFrame) -> int:
        """Add rows to any number of tables in one commit; their days get a further version."""
        version, state = self.state()
        version += 1
        new = {t: dict(days) for t, days in state.items()}
        for table, df in tables.items():
            stored = new.setdefault(table, {})
            for day in self._write(df, table, version):
                stored[day] = [*stored.get(day, []), version]
        self.manifests.write(version, new)
        return version

    def change(self, **changes: tuple[DataFrame, Callable[[DataFrame], DataFrame]]) -> int:
        """Change tables in one commit. Each change is (rows that name the touched days in
        ``event_date``, a function of the rows of these days); other days keep their files."""
        version, state = self.state()
        new = {t: dict(days) for t, days in state.items()}
        for table, (touched, transform) in changes.items():
            days = [NO_DAY if r[0] is None else str(r[0])
                    for r in touched.select("event_date").distinct().collect()]
            if not days:
                continue
            rows = self._read(state.get(table, {}), table, days, False)
            written = self._write(transform(rows), table, version + 1)
            for day in days:
                new[table].pop(day, None)
            for day in written:
                new[table][day] = [*new[table].get(day, []), version + 1]
        if new != state:
            version += 1
            self.manifests.write(version, new)
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the newest ``keep``, and folders none of these lists."""
        numbers = self.manifests.numbers()
        for number in numbers[:-keep]:
            self.manifests.remove(number)
        live: dict[str, set[tuple[str, str]]] = {}
        for number in numbers[-keep:]:
            for table, days in self.manifests.read(number).items():
                live.setdefault(table, set()).update(
                    (str(v), day) for day, versions in days.items() for v in versions)
        for table, used in live.items():
            for folder in self.manifests.folders(f"{self.root}/{table}"):
                version = folder.removeprefix("v=")
                path = f"{self.root}/{table}/{folder}"
                # A version above the newest manifest may be a commit on its way.
                if int(version) > numbers[-1]:
                    continue
                days = self.manifests.folders(path)
                gone = [d for d in days if (version, d.removeprefix("event_date=")) not in used]
                for day in days if len(gone) == len(days) else gone:
                    self.manifests.delete_folder(f"{path}/{day}")
                if len(gone) == len(days):
                    self.manifests.delete_folder(path)

    # -- the changes of the library ------------------------------------------------------

    def upsert_pass_ends(self, updates: DataFrame) -> int:
        """End and total of passes from their newest update; only the days of these passes."""
        ids = updates.select("test_pass_id").distinct()
        touched = self.read("test_passes", dated=True).join(ids, "test_pass_id", "left_semi")
        return self.change(test_passes=(touched, lambda rows: upsert_pass_end(rows, updates)))

    def scrub(self, table: str, rules: list[Scrub]) -> int:
        """Apply scrub rules; only days in which a rule changes a value."""
        rows = self.read(table, dated=True)
        columns = {r.column: F.col(r.column).alias(f"_old_{r.column}") for r in rules}
        scrubbed = scrub(rows.select("*", *columns.values()), rules)
        changed = [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns]
        differs = changed[0]
        for other in changed[1:]:
            differs = differs | other
        return self.change(**{table: (scrubbed.filter(differs), lambda rows: scrub(rows, rules))})

    def cascade_delete(self, condition: Column) -> int:
        """Delete passes with their tests and the actions of those, in one commit."""
        passes = self.read("test_passes", dated=True).filter(condition)
        gone = passes.select("test_pass_id")
        results = self.read("test_results", dated=True).join(gone, "test_pass_id", "left_semi")
        tests = results.select("test_id")
        actions = self.read("test_actions", dated=True).join(tests, "test_id", "left_semi")
        return self.change(
            test_passes=(passes, lambda p: p.filter(~F.coalesce(condition, F.lit(False)))),
            test_results=(results, lambda r: r.join(gone, "test_pass_id", "left_anti")),
            test_actions=(actions, lambda a: a.join(tests, "test_id", "left_anti")))
