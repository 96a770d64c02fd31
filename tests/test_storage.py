"""Table creation, appends, layouts and the text source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.sources import readers, storage
from faultline.sources.derived import Tables
from faultline.sources.schemas import FOREIGN_KEYS, TABLES


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


@pytest.mark.parametrize("name", list(TABLES))
def test_derived_tables_have_the_declared_columns_and_types(tables, name):
    declared = {f.name: f.dataType for f in TABLES[name].fields}
    assert {f.name: f.dataType for f in getattr(tables, name)().schema.fields} == declared


def test_foreign_keys_name_existing_columns():
    for child, child_key, parent, parent_key in FOREIGN_KEYS:
        assert TABLES[child][child_key].dataType == TABLES[parent][parent_key].dataType


def test_create_is_idempotent_and_drop_starts_over(spark, tables):
    storage.create_tables(spark, "runs", drop=True)
    storage.with_date(tables.test_results().limit(5).select(*TABLES["test_results"].fieldNames()),
                      "test_results").write.mode("append").partitionBy("event_date").format(
        "parquet").saveAsTable("runs.test_results")
    storage.create_tables(spark, "runs")
    assert spark.table("runs.test_results").count() == 5
    assert {t.name for t in spark.catalog.listTables("runs")} == set(TABLES)
    storage.create_tables(spark, "runs", drop=True)
    assert spark.table("runs.test_results").count() == 0
    spark.sql("DROP DATABASE runs CASCADE")


def test_append_and_pruned_read(spark, tables, tmp_path):
    root = str(tmp_path)
    storage.append_test(tables.test_results(), tables.test_actions(), root)
    storage.append(tables.build_node(), root, "build_node")
    everything = readers.read_table(spark, root, "test_results")
    names = TABLES["test_results"].fieldNames()
    assert everything.exceptAll(tables.test_results().select(*names)).count() == 0
    assert everything.count() == tables.test_results().count()
    first, last = "2000-01-01", "2000-03-31"
    some = readers.read_table(spark, root, "test_results", (first, last))
    day = F.to_date("time_started")
    assert some.count() == everything.filter(day.between(F.lit(first), F.lit(last))).count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert readers.read_table(spark, root, "test_actions").count() == tables.test_actions().count()
    assert readers.read_table(spark, root, "build_node").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_table(spark, root, "accounts").count()


def test_bucketed_tables_join_without_a_shuffle(spark, tables):
    storage.save_bucketed(tables.test_results(), "bucketed_results", "test_id", 8)
    storage.save_bucketed(tables.test_actions(), "bucketed_actions", "test_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_results").select("test_id", "test_name").join(
            spark.table("bucketed_actions").select("test_id", "function_name"), "test_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == tables.test_actions().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
        spark.sql("DROP TABLE bucketed_results")
        spark.sql("DROP TABLE bucketed_actions")


def test_versions_are_written_side_by_side(spark, tmp_path):
    one = storage.rewrite(spark.range(3), str(tmp_path), "t", 1)
    two = storage.rewrite(spark.read.parquet(one).filter("id > 0"), str(tmp_path), "t", 2)
    assert spark.read.parquet(one).count() == 3 and spark.read.parquet(two).count() == 2


def test_shared_dir_uses_the_cluster_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = storage.shared_dir(spark), storage.shared_dir(spark)
    assert one.startswith(root) and one != two


def test_definitions_from_a_file(spark, tmp_path):
    path = tmp_path / "defs"
    path.write_text("# comment\n\nsysbench rw 1000 4 1@4 60 h1@h2 pre\n"
                    "sysbench in-memory 1 3600 h1 small\ntpcc-mysql 10 2 60 h3 t\nother a b\n")
    rows = {(r.benchmark_type, r.name_prefix): r
            for r in readers.read_definitions(spark, str(path)).collect()}
    assert len(rows) == 4
    assert rows["sysbench", "pre"].hosts == "h1@h2"
    ragged = rows["sysbench", None]
    assert (ragged.ro_rw, ragged.threads, ragged.run_seconds, ragged.hosts) == (
        "in-memory", "h1", "small", None)
    assert rows["tpcc-mysql", "t"].table_size == "0"
    runs = readers.expand_runs(readers.read_definitions(spark, str(path))).collect()
    assert sorted(r.benchmark_name for r in runs) == sorted(
        [f"pre_sysbench_{h}_rw_th{t}_ts1000_tc4_time60" for h in ("h1", "h2") for t in "14"]
        + ["t_tpcc_h3_w10_th2_time60"])


def test_print_table(spark, capsys):
    storage.print_table(spark.createDataFrame([(dt.date(2001, 1, 1),)], "day date"))
    assert "2001-01-01" in capsys.readouterr().out
