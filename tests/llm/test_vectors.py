"""Whitening, centroid clustering and token files against plain versions, and their edge cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import op12_centroids, op13_token_files
from faultline.llm.common import table
from faultline.llm.op11_whitening import top_eigenpairs, whiten
from faultline.llm.op12_centroids import VantageTree, cluster
from faultline.llm.op13_token_files import IndexPart, build_index, read_documents, write_ids
from faultline.llm.queries import TOKENIZER, WORD_TOKENIZER, oracle_sql, queries
from tests.compare import connect, differences

VECTORS = "vec_id long, embedding array<float>, x string, cluster int, n long"


def plain_vectors(rows):
    return [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]


# -- whitening -----------------------------------------------------------------------------------

SPECTRA = {
    "flat tail": np.r_[1e4, 1e3, np.ones(298)], "close": np.linspace(1, 2, 300),
    "steep": np.logspace(4, -8, 64), "low rank": np.r_[np.ones(5), np.zeros(95)],
    "equal": np.ones(100), "tied across the cut": np.r_[np.full(20, 5.0), np.ones(44)],
    "power": 1 / np.arange(1, 200) ** 2.0, "small": np.array([3.0, 1.0, 0.0]),
    "zero": np.zeros(50),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs_of_known_spectra(name):
    spectrum = SPECTRA[name]
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    v = (q * spectrum) @ q.T
    values, axes = top_eigenpairs(lambda x: v @ x, len(v), 16)
    expected = np.sort(spectrum)[::-1][:16]
    scale = max(spectrum.max(), 1e-300)
    assert np.abs(values - expected).max() <= 1e-13 * scale
    assert np.abs(v @ axes - axes * values).max() <= 1e-12 * scale
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() <= 1e-12


def check_whitening(rows, found, count=16):
    """Against a dense solver on the covariance of the distinct rows."""
    kept = plain_vectors(rows)
    width = max((len(x) for _, x in kept), default=0)
    if not width:
        assert found == []
        return
    full = [(i, np.pad(x, (0, width - len(x))) + 1_000_000) for i, x in kept]
    fit = np.array(sorted({tuple(x) for _, x in full}), np.int64).reshape(-1, width)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n if n else fit
    values, axes = np.linalg.eigh(centred.T @ centred / max(n, 1)) if width else (np.zeros(0), None)
    values = values[::-1][:count]
    real = int((values > 16 * width * np.finfo(float).eps * max(values.max(initial=0), 0)).sum())
    assert len(found) == real * len(full)
    if not real:
        return
    axes = axes[:, ::-1][:, :real]
    trace = (centred**2).sum() / n
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, real + 1))
    for j in range(real):
        mine = by_component[j + 1]
        expected = Counter((i, n, int(((n * x.astype(object) - sums) ** 2).sum())) for i, x in full)
        assert Counter((r.vec_id, r.n, r.deviation) for r in mine) == expected
        assert all(abs(r.explained - values[j] / trace) <= 1e-9 for r in mine)
        assert all(r.identity_error <= 1e-8 for r in mine)
        gap = min([abs(values[j] - v) for k, v in enumerate(np.linalg.eigvalsh(
            centred.T @ centred / n)[::-1]) if k != j] or [1])
        if gap > 1e-6 * values[0]:
            whitened = {}
            for r in mine:
                whitened.setdefault((r.vec_id, r.deviation), []).append(r.whitened)
            want = {}
            for i, x in full:
                key = (i, int(((n * x.astype(object) - sums) ** 2).sum()))
                want.setdefault(key, []).append(
                    float(((x * n - sums) / n) @ axes[:, j]) / np.sqrt(values[j]))
            a = np.concatenate([sorted(whitened[k]) for k in sorted(want, key=str)])
            b = np.concatenate([sorted(want[k]) for k in sorted(want, key=str)])
            c = np.concatenate([sorted(-v for v in want[k]) for k in sorted(want, key=str)])
            assert min(np.abs(a - b).max(), np.abs(a - c).max()) <= 1e-7


def test_whitening_query_matches_a_dense_solver(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    found = queries()["op11_whitening"](spark, sf_dir).collect()
    check_whitening(rows, found)


def vectors_of(rng, n, width, spread):
    return [[float(np.float32(v)) for v in rng.normal(0, spread, width)] for _ in range(n)]


ODD = [(None, [1.0, 2.0, 0.5]), (7, None), (8, [1.0, None, 2.0]), (9, [float("nan"), 1.0, 1.0]),
       (10, [float("inf"), 0.0, 0.0]), (11, [1.0]), (12, []), (13, [0.25, 0.5, 0.75]),
       (13, [0.25, 0.5, 0.75]), (13, [4.0, -4.0, 1.0]), (14, [4.0, -4.0, 1.0])]


@pytest.mark.parametrize("rows", [
    ODD, [], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])],
    [(i, [float(i), float(i), 0.0]) for i in range(20)],
])
def test_whitening_of_odd_tables(spark, rows):
    df = spark.createDataFrame([(i, v, "t", 1, 2) for i, v in rows], VECTORS)
    check_whitening(rows, whiten(df).collect())


def test_whitening_with_copies_and_more_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(vectors_of(rng, 300, 50, 3))]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    df = spark.createDataFrame([(i, v, "t", 1, 2) for i, v in rows], VECTORS).repartition(7)
    check_whitening(rows, whiten(df, count=5).collect(), count=5)


# -- clustering ------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 6), st.randoms())
def test_tree_finds_the_nearest_of_smallest_number(k, width, spread, random):
    draw = lambda n: np.array([[random.randint(-spread, spread) for _ in range(width)]
                               for _ in range(n)], np.int64)
    centroids, x = draw(k), draw(30)
    best, least, _ = VantageTree.build(centroids).nearest(x)
    square = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (least == square.min(1)).all()
    assert (best == square.argmin(1)).all()


def test_tree_leaves_most_centroids_out_where_they_lie_apart():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-10**6, 10**6, (500, 3))
    x = rng.integers(-10**6, 10**6, (1000, 3))
    best, least, evaluated = VantageTree.build(centroids).nearest(x)
    square = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (least == square.min(1)).all() and (best == square.argmin(1)).all()
    assert evaluated < 1000 * 500 / 4


def plain_clusters(rows, count, rounds, width):
    kept = [(i, x) for i, x in plain_vectors(rows) if len(x) == width]
    key = lambda t: (t[0] is None, hashlib.sha256(f"1:{t[0]}".encode()).hexdigest(), list(t[1]))
    places = [list(map(int, x)) for _, x in sorted(kept, key=key)[:count]]

    def nearest(x):
        return min((sum((int(a) - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(places))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for c in set(of):
            mine = [x for (_, x), d in zip(kept, of) if d == c]
            places[c] = [int(sum(int(x[i]) for x in mine)) // len(mine) for i in range(width)]
    last = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, c in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in last)


def test_clustering_query_matches_plain_and_sql(spark, sf_dir):
    found = queries()["op12_centroids"](spark, sf_dir)
    assert differences(found, connect(sf_dir), oracle_sql()["op12_centroids"]) == []
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows, 16, 3, 64)


@pytest.mark.parametrize("rows", [
    ODD, [], [(1, None)], [(1, [1.0, 2.0, 3.0])] * 5,
    [(i % 4, [float(i % 3), 1.0, -float(i % 2)]) for i in range(40)],
])
def test_clustering_of_odd_tables(spark, rows):
    df = spark.createDataFrame([(i, v, "t", 1, 2) for i, v in rows], VECTORS)
    found = cluster(df, centroids=4, rounds=2, width=3)
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows, 4, 2, 3)


def test_clustering_of_copies_over_many_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(vectors_of(rng, 200, 4, 1))]
    rows += [(500 + i, rows[3][1]) for i in range(120)]
    df = spark.createDataFrame([(i, v, "t", 1, 2) for i, v in rows], VECTORS).repartition(9)
    assert Counter(map(tuple, cluster(df, 16, 3, 4).collect())) == plain_clusters(rows, 16, 3, 4)


def test_clustering_refuses_components_without_a_long_distance(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0], "t", 1, 2)], VECTORS)
    with pytest.raises(Exception, match="no long distance"):
        cluster(df, 2, 1, 2).collect()


# -- token files -----------------------------------------------------------------------------------

DOCS = "doc_id long, text string, start long, copy long, n string"


def plain_tokens(rows):
    """By id in ascending order, the order among equal ids left open."""
    library = Tokenizer.from_file(WORD_TOKENIZER)
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]


def check_tokens(rows, found):
    expected = plain_tokens(rows)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(
        (i, len(ids), crc(ids)) for i, ids in expected)
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_token_file_query_matches_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    check_tokens(rows, queries()["op13_token_files"](spark, sf_dir).collect())


ODD_DOCS = [(None, "no id"), (None, None), (5, None), (3, ""), (3, ""), (3, "same id"), (-4, "a # b"),
            (9, "<|endoftext|> x<|startoftext|>y 日本語 z\x0bq\x1cw\x85v"), (8, "word " * 30_000),
            (7, "ÀÉ é don't I'LL İx ΑΣ Σ̈ ̈ x​y"), (10**18, "end")]


@pytest.mark.parametrize("rows", [ODD_DOCS, [], [(1, None)], [(4, "same")] * 30])
def test_token_files_of_odd_tables(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(op13_token_files, "SHARD_BYTES", (200, 200))
    df = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], DOCS)
    found = op13_token_files.write_and_read(df, str(tmp_path / "files"), WORD_TOKENIZER).collect()
    check_tokens(rows, found)


def test_every_letter_of_the_first_blocks_keeps_its_ids():
    """Also one whose lower case lies far away, like that of Ⱥ or Ɓ."""
    encoder = _encoder()
    for text in [f for c in map(chr, range(0x20, 0x250)) for f in (c, f"a{c}b {c}")]:
        ids = np.frombuffer(encoder(text.encode()), "<u2")
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from(
    list(" \t\n\r\x0b\x0c\x1c\x85\xa0 'sS") + ["ll", "\u0301", "Σ", "İ", "<|endoftext|>"]))))
def test_pieces_give_the_ids_of_the_whole_text(parts):
    text, encoder = "".join(parts), _encoder()
    ids = np.frombuffer(encoder(text.encode()), "<u2")
    assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    list("aZé9Ǆİß²Σ.,'!*|<> ") + ["ll", "'s", "The", "<|endoftext|>", "=\u0338", "~~~", "ŉ"])))
def test_words_and_punctuation_give_the_ids_of_the_whole_text(parts):
    text, encoder = "".join(parts), _encoder()
    ids = np.frombuffer(encoder(text.encode()), "<u2")
    assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_long_words_and_other_texts_give_the_ids_of_the_library(spark, sf_dir):
    encoder = _encoder()
    texts = [r.text or "" for r in table(spark, sf_dir, "documents").collect()]
    texts += ["a" * 3000 + " b", "日本 a few words 語 x", "", "  ", "\x01 x\x01", "²³ ª º µ ½"]
    for text in texts:
        ids = np.frombuffer(encoder(text.encode()), "<u2")
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    encoder = op13_token_files.Encoder(TOKENIZER)
    text = "two  spaces\nand <|endoftext|> more"
    assert encoder.fast is None
    assert np.frombuffer(encoder(text.encode()), "<u2").tolist() == (
        encoder.library.encode(text, add_special_tokens=False).ids)


def _encoder(known=[]):  # noqa: B006
    if not known:
        known.append(op13_token_files.Encoder(WORD_TOKENIZER))
    return known[0]


@pytest.mark.parametrize("end", [2, 49407])
def test_keyed_access_by_small_reads(spark, sf_dir, tmp_path, end, monkeypatch):
    monkeypatch.setattr(op13_token_files, "SHARD_BYTES", (20_000, 20_000))
    monkeypatch.setattr(op13_token_files, "PART_KEYS", 50)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id < 3")).union(
        spark.createDataFrame([(None, "lost")], "doc_id long, text string"))
    layout = write_ids(docs, str(tmp_path / "files"), WORD_TOKENIZER, end=end)
    reader = op13_token_files.Reader(spark, layout)
    library = Tokenizer.from_file(WORD_TOKENIZER)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [end]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc in [0, 1, 2, 17, 199, None]:
        assert reader.get(doc).tolist() == ids(texts[doc])
    assert reader.get(1, copy=1).tolist() == ids(texts[1])
    for missing in [(1, 2), (17, 1), (10**9, 0), (-1, 0), (None, 1)]:
        assert reader.get(*missing) is None
    asked = spark.createDataFrame([(17, 0), (1, 1), (10**9, 0), (None, 0), (18, 4)],
                                  "doc_id long, copy long")
    found = {(r.doc_id, r["copy"]): np.frombuffer(r.ids, "<u4").tolist()
             for r in read_documents(asked, layout, with_ids=True).collect()}
    assert found == {(17, 0): ids(texts[17]), (1, 1): ids(texts[1]), (None, 0): ids("lost")}


def test_index_is_a_minimal_perfect_hash():
    n = 20_000
    rng = np.random.default_rng(4)
    doc = rng.integers(-2**62, 2**62, n)
    null, copy = np.zeros(n, np.int64), rng.integers(0, 3, n)
    content = build_index(doc, null, copy, doc % 7, doc % 11, np.arange(n), doc % 13)
    reads = []

    def read(at, length):
        reads.append(length)
        return content[at:] if length < 0 else content[at:at + length]

    index = IndexPart(read)
    found, known = index.slots(doc, null, copy)
    assert known.all() and (found["at"] == np.arange(n)).all()
    assert sorted(found["at"].tolist()) == list(range(n))
    found, known = index.slots(doc, null, copy + 3)
    assert not known.any()
    assert len(content) < n * (op13_token_files.SLOT.itemsize + 2)
    reads.clear()
    for i in range(200):
        assert int(index.slot(int(doc[i]), int(copy[i]))["at"]) == i
    assert max(reads) <= op13_token_files.SLOT.itemsize and len(reads) < 200 * 8


def test_payload_files_hold_ids_alone(spark, tmp_path):
    rows = [(i, f"text {i} # of words") for i in range(50)]
    df = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], DOCS)
    layout = write_ids(df, str(tmp_path / "files"), WORD_TOKENIZER)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(f"{layout.path}/data/kind=ids").orderBy("path").collect())
    ids = np.concatenate([np.frombuffer(f.content, "<u2") for f in files])
    assert ids.tolist() == [i for _, doc in plain_tokens(rows) for i in doc]


def test_clusters_need_no_more_than_named_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert cluster(df.withColumn("inertia", F.lit("x")), 2, 1, 2).count() == 1
    assert op12_centroids.oracle().count("kept") > 1
