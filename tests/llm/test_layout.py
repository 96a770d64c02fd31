"""Search, sharding, packing and the pipeline against plain versions, and their edge cases."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import op3_topk, op4_pii, op5_jaccard, op6_quality, op7_sharding, op9_packing
from faultline.llm import op10_decontamination
from faultline.llm.common import table
from faultline.llm.components import connected
from faultline.llm.queries import PATTERN, TOKENIZER, queries

DOCS = "doc_id long, text string, size long, item string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, 5, "a"), (2, "", 5, "a"), (3, "word " * 20_000, 5, "a"), (4, "short", 5, "a"),
            (4, "short", 5, "a"), (5, "<|endoftext|> 日本語  \n\n x", 5, "a"), (None, "no id", 5, "a")]
    return spark.createDataFrame(rows, DOCS)


# -- components --------------------------------------------------------------------------------

def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    edges += [(i, 1000) for i in range(2000, 2010)] + [(7, 7)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(201))
    assert all(found[i] == 1000 for i in [*range(1000, 1050), *range(2000, 2010)])
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# -- search ------------------------------------------------------------------------------------

def plain_top(rows, k, every):
    good = [(i, np.floor(64 * np.array(x, float)).astype(np.int64)) for i, x in rows
            if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    best = defaultdict(dict)
    for q, x in good:
        if q % every == 0:
            for c, y in good:
                if c != q:
                    n = min(len(x), len(y))
                    score = int(x[:n] @ y[:n])
                    best[q][c] = max(score, best[q].get(c, score))
    return {(q, r + 1, c, s) for q, of in best.items()
            for r, (c, s) in enumerate(sorted(of.items(), key=lambda t: (-t[1], t[0]))[:k])}


def as_set(df):
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_search_query_matches_plain(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert as_set(queries()["op3_exact_topk"](spark, sf_dir)) == plain_top(rows, 20, 20)


def test_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op3_topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(op3_topk, "CANDIDATE_BLOCK", 150)
    monkeypatch.setattr(op3_topk, "FIRST_CHUNK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, 700)] + rng.normal(scale=0.02, size=(700, 12))
    x[::9] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert as_set(op3_topk.top_k(df, k=5, every=10)) == plain_top(rows, 5, 10)


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [1.0, float("inf")]),
            (5, [1.0]), (6, []), (20, [2.0, 2.0]), (20, [3.0, -9.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
            (None, [1.0, 1.0]), (8, [1e6, 1e6]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows],
                               "vec_id long, embedding array<double>, score int")
    assert as_set(op3_topk.top_k(df, k=20, every=20)) == plain_top(rows, 20, 20)
    assert op3_topk.top_k(df.limit(0)).count() == 0
    assert op3_topk.top_k(df.filter("vec_id = 20"), every=20).count() == 0


def test_search_stops_early():
    """Clustered candidates: most are never multiplied."""
    rng = np.random.default_rng(1)
    centres = 300 * rng.normal(size=(20, 16))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 3).astype(np.int64)
    largest = float((x.astype(float) ** 2).sum(1).max())
    pivots = op3_topk.choose_pivots(op3_topk.lifted(x[:500], largest))
    d = op3_topk.distances(op3_topk.lifted(x, largest), pivots)
    # A query at the largest norm: its nearest candidates are its own cluster.
    q = x[np.argmax((x**2).sum(1))][None, :]
    dq = op3_topk.distances(np.column_stack([q, np.zeros(1)]), pivots)
    done, products = [], op3_topk._products

    def counting(a, b):
        done.append(len(a))
        return products(a, b)
    op3_topk._products = counting
    try:
        _, ids, score = op3_topk.search_cell(np.array([-1]), q, dq, np.arange(4000), x, d, largest, 5)
    finally:
        op3_topk._products = products
    every = x @ q[0]
    assert sorted(score, reverse=True) == sorted(every, reverse=True)[:5] and sum(done) < 3000


# -- sharding ----------------------------------------------------------------------------------

def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected


def test_shard_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    check_shards(queries()["op7_shards"](spark, sf_dir).collect(), texts, 40)


def test_shards_are_even_and_groups_stay(spark):
    texts = [(i, f"text {i} " + "x" * (i * 37 % 400)) for i in range(3000)]
    texts += [(5000 + i, f"pair {i % 300}") for i in range(600)]
    texts += [(9000 + i, "hot " * 30) for i in range(1500)]
    rows = op7_sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 10).collect()
    check_shards(rows, texts, 10)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) / min(load.values()) < 1.02
    shard = {r.doc_id: r.shard for r in rows}
    assert all(shard[5000 + i] == shard[5300 + i] for i in range(300))


def test_shard_edges(spark, odd, tmp_path):
    check_shards(op7_sharding.shard(odd, 3).collect(), [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert op7_sharding.shard(odd.limit(0)).count() == 0
    op7_sharding.write_shards(odd, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out")).select(*odd.columns)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(back) == key(odd)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 6))
def test_placing_takes_the_highest_dot_product(sizes, shards):
    items = np.array([(s, s // 5, 1) for s in sizes])
    out = op7_sharding.place(items, shards)
    share = np.maximum(items.sum(0) / shards, 1e-9)
    left, scale = np.ones((shards, 3)), np.array(op7_sharding.WEIGHTS)
    for i in np.lexsort((np.arange(len(items)), -(items / share * scale).sum(1))):
        values = [float(sum(scale * (items[i] / share) * row)) for row in left]
        assert values[out[i]] >= max(values) - 1e-9
        left[out[i]] -= items[i] / share


# -- packing -----------------------------------------------------------------------------------

def plain_pieces(rows, capacity=1024):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for doc, text in rows:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        start = 0
        for piece, end in enumerate(cuts):
            part = ids[start:end]
            out[(doc, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
            start = end
    return out


def check_packing(rows, pieces):
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows) == pieces
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r["offset"], r["length"]))
    for of in places.values():
        end = 0
        for offset, length in sorted(of):
            assert offset == end
            end += length
        assert end <= 1024
    return len(places)


def test_packing_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    rows = queries()["op9_packing"](spark, sf_dir).collect()
    used = check_packing(rows, plain_pieces(texts))
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_edges(spark, odd):
    rows = op9_packing.pack(odd, TOKENIZER, PATTERN).collect()
    check_packing(rows, plain_pieces([(r.doc_id, r.text) for r in odd.collect()]))
    assert op9_packing.pack(odd.limit(0), TOKENIZER, PATTERN).count() == 0


def test_packed_ids_are_the_texts(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 50)) for i in range(60)],
                                 "doc_id long, text string")
    packed = op9_packing.pack(docs, TOKENIZER, PATTERN, with_ids=True)
    own = Tokenizer.from_file(TOKENIZER)
    ids = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in op9_packing.packed_ids(packed).collect()}
    parts = defaultdict(dict)
    for r in packed.collect():
        parts[r.doc_id][r.piece] = ids[r.sequence_id][r["offset"]:r["offset"] + r["length"]]
    for row in docs.collect():
        whole = np.concatenate([parts[row.doc_id][p] for p in sorted(parts[row.doc_id])])
        assert whole.tolist() == own.encode(row.text, add_special_tokens=False).ids + [2]


def plain_best_fit(counts, capacity):
    """Contents of the sequences, every piece placed by itself."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights) / full**2
    free, contents = [], []
    for n in sorted(counts, reverse=True):
        piece = np.array([n, 1, n * n], float)
        for _ in range(counts[n]):
            fits = [(float((((room - piece) ** 2) * weights).sum()), s)
                    for s, room in enumerate(free) if (room >= piece).all()]
            if not fits:
                free.append(full)
                contents.append([])
            s = min(fits)[1] if fits else len(free) - 1
            free[s] = free[s] - piece
            contents[s].append(n)
    return contents


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 30), max_size=12), st.integers(1, 6),
       st.integers(0, 300))
def test_plan_is_the_one_of_placing_piece_by_piece(counts, documents, extra):
    capacity = op9_packing.Capacity(20, documents, 400 + extra, (1, 0.3, 0.3))
    plan = op9_packing.pack_histogram(counts, capacity)
    got = defaultdict(list)
    for n, pieces, first in zip(*(plan[k].tolist() for k in ("length", "pieces", "sequence"))):
        for k in range(pieces):
            got[first + k].append(n)
    want = plain_best_fit(counts, capacity)
    assert [sorted(got[s], reverse=True) for s in range(len(want))] == want and len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 30), max_size=12), st.integers(1, 6),
       st.integers(0, 300))
def test_plan_keeps_every_capacity(counts, documents, extra):
    capacity = op9_packing.Capacity(20, documents, 400 + extra - extra % 7, (1, 0.3, 0.3))
    plan = op9_packing.pack_histogram(counts, capacity)
    bins, ranks = defaultdict(list), defaultdict(list)
    for n, rank, pieces, first, offset in zip(*(plan[k].tolist() for k in (
            "length", "rank", "pieces", "sequence", "offset"))):
        ranks[n] += range(rank, rank + pieces)
        for k in range(pieces):
            bins[first + k].append((offset, n))
    assert {n: list(range(c)) for n, c in counts.items() if c} == {n: sorted(r) for n, r in ranks.items()}
    for parts in bins.values():
        assert len(parts) <= documents and sum(n * n for _, n in parts) <= capacity.attention
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 20


def test_encoder_equals_the_library():
    encoder, own = op9_packing.Encoder(TOKENIZER, PATTERN), Tokenizer.from_file(TOKENIZER)
    for text in ["", "  a   b \n\n c\t\td ", "<|endoftext|> x", "日本語 テキスト", "1234 5678's it's we'LL",
                 "é  x", "\x1c\x1d a", "a" * 3000, "Ünï—«quoted»… €5", "  nbsp thin", "😀😀 x"]:
        assert encoder(text).tolist() == own.encode(text, add_special_tokens=False).ids


# -- pipeline ----------------------------------------------------------------------------------

def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "personal_data", "packing"]
    extra = docs.withColumn("_hit", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, extra, sf_dir)
        assert kept.columns == extra.columns
        assert kept.count() < docs.count() if name != "personal_data" else kept.count() == docs.count()


def test_run_matches_the_plain_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels, benchmark = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    good = {r.doc_id for r in op6_quality.classify(docs, labels).collect() if r.predicted == 1}
    docs = docs.filter(F.col("doc_id").isin(*good))
    first = {r.doc_id for r in op5_jaccard.components(docs).collect() if r.component_id == r.doc_id}
    docs = docs.filter(F.col("doc_id").isin(*first))
    clean = {r.doc_id for r in op10_decontamination.judged(docs, benchmark).collect() if not r.contaminated}
    docs = docs.filter(F.col("doc_id").isin(*clean))
    texts = [(r.doc_id, r.text) for r in op4_pii.redact(docs).collect()]
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), plain_pieces(texts))


def test_pipeline_edges(spark, tmp_path, sf_dir):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, sf_dir).count() == 5
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


@pytest.mark.parametrize("room", [None, 0])
def test_near_duplicates_shuffle_no_other_texts_than_those_of_equal_rows(spark, monkeypatch, room):
    """The same rows stay if the keys are too many for a broadcast."""
    if room is not None:
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", room)
    rows = [(i, f"{i} one text of {i} that is like no other of {i * i}") for i in range(50)]
    rows += [rows[3], rows[3], rows[7], (90, rows[9][1]), (91, None), (91, None), (None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shuffled, drop = [], type(docs).dropDuplicates

    def seen(self, *by):
        shuffled.append(self.count())
        return drop(self, *by)
    monkeypatch.setattr(type(docs), "dropDuplicates", seen)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert Counter(map(tuple, kept.collect())) == Counter(rows[:50] + [(91, None)] + 2 * [(None, "a")])
    assert shuffled[-1] == (7 if room is None else 55)


def test_near_duplicates_of_texts_that_share_an_id(spark, sf_dir):
    """Different texts under one id stay; copies go whatever their ids, the smallest id stays."""
    one, two, three = ("a b c d e f g", "other words that say something else", "neither of the two")
    rows = [(5, one), (5, two), (5, two), (2, three), (9, one), (7, two), (2, one), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, one), (5, two), (2, three), (8, None), (8, "")], key=str)
