"""Texts and tags that once ended a task or lost text, and groups of equal texts."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.llm import op2_license_scan, op7_sharding
from faultline.llm.common import table
from faultline.llm.op8_html import page_lines

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("text,whole", [
    ("copyright acme\n" * 200_000 + "\n" + op2_license_scan.MIT, "MIT"),
    ("the licence\n" + "\n \t\n" * 200_000 + "x", ""),
    ("# the licence\n" + "#\n" * 200_000 + "# Licensed under the MIT License.", ""),
    ("the licence " * 200_000, ""),
])
def test_licences_in_texts_of_very_many_lines(spark, text, whole):
    df = spark.createDataFrame([(1, text)], DOCS)
    row = op2_license_scan.scan(df, op2_license_scan.known_digests(spark)).first()
    assert row.whole_licences == whole


@pytest.mark.parametrize("html,lines", [
    ('<article><p>see <a href="/forum?id=search">the forum</a> now</p></article>',
     ["see the forum now"]),
    ('<article><p><a href="/a" title="the hidden truth">anchor text</a></p></article>',
     ["anchor text"]),
    ('<article><div data-hidden="false">shown</div></article>', ["shown"]),
    ('<article><div data-class="menu">shown</div></article>', ["shown"]),
    ('<article><span aria-label="hidden gem">shown</span></article>', ["shown"]),
    ('<article><p title=\'class="menu"\' data-id=sidebar>shown</p></article>', ["shown"]),
    ("<article><div hidden>gone</div><div HIDDEN=''>gone</div>shown</article>", ["shown"]),
    ('<article><div\nclass\n=\n"menu">gone</div><div id=sidebar>gone</div>shown</article>', ["shown"]),
    ('<article><div style="color:red; display : none">gone</div>shown</article>', ["shown"]),
])
def test_attributes_are_read_one_after_the_other(html, lines):
    assert [text for text, _ in page_lines(html)] == lines


def shards_of(rows):
    found = defaultdict(set)
    for r in rows:
        found[r.text].add(r.shard)
    return found


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_group_that_fits_a_shard_is_parted(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    placed = op7_sharding.shard(docs, 40)
    text = F.coalesce("text", F.lit(""))
    groups = docs.groupBy(text.alias("text")).agg(
        F.sum(F.octet_length("text") + 16).alias("bytes"), F.count("*").alias("n"))
    total = groups.agg(F.sum("bytes")).first()[0]
    fit = {r.text for r in groups.filter(F.col("bytes") * 40 <= total).collect()}
    rows = docs.join(placed, "doc_id").select(text.alias("text"), "shard").collect()
    assert len(fit) > 100 and all(len(s) == 1 for t, s in shards_of(rows).items() if t in fit)
    sizes = [r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40
    if sf != "sf0.001":
        assert max(sizes) <= 1.05 * total / 40


def test_a_group_beyond_a_shard_is_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("own text "), "id")).alias("text"))
    rows = docs.join(op7_sharding.shard(docs, 10), "doc_id").select("text", "shard", "size").collect()
    found = shards_of(rows)
    assert len(found["the same text"]) > 1
    assert all(len(s) == 1 for t, s in found.items() if t != "the same text")
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 10
