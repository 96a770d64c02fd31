"""Id ranges handed out one per append, so new ids need no look at stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.operators.ranks import assign_ids
from faultline.sources.files import Folder


class IdLedger:
    """Ranges reserved so far, one numbered file each: ``first`` and ``count``.

    A range is taken by writing the next number, which is refused to all but one of the appends
    that try; the others go on to the number after it. Ranges therefore never overlap and follow
    one another. An append that fails leaves its range unused.
    """

    # Only the newest ranges are kept: the next one begins where the last one ends.
    KEPT = 100

    def __init__(self, spark: SparkSession, path: str):
        self.files = Folder(spark, path)

    def reserve(self, count: int, first: int = 1) -> int:
        """The first id of a new range of ``count``; the very first range begins at ``first``."""
        while True:
            numbers = self.files.numbers()
            if numbers:
                last = self.files.read(numbers[-1])
                first = last["first"] + last["count"]
            number = numbers[-1] + 1 if numbers else 0
            try:
                self.files.write(number, {"first": first, "count": count})
            except FileExistsError:
                continue
            for old in numbers[:-self.KEPT]:
                self.files.remove(old)
            return first


def with_new_ids(df: DataFrame, ledger: IdLedger, *, id_name: str, time: str, order: list[str]
                 ) -> DataFrame:
    """The rows of one append with dense ids of their own range, in natural-key order. They are
    counted once to size the range."""
    first = ledger.reserve(df.count())
    return assign_ids(df, id_name=id_name, time=time, order=order, start=first - 1)
