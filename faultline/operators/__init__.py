"""Report, roll-up, snapshot and table-maintenance operators: DataFrames in, DataFrame out.

Joins carry no hints. Spark broadcasts a side when its measured size is below the session's
threshold (from file statistics, or at run time through adaptive execution) and otherwise
sort-merges with adaptive skew splitting. Measures that can be combined are aggregated before
the join, so a pass or test that owns a large part of the rows reaches the shuffle as a few
partial rows per task.
"""
