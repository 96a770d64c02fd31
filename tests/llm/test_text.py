"""The operators on texts and pages against plain versions, and their edge cases."""

import bisect
import hashlib
import math
import re
import string
import textwrap
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import (
    op1_url_filter, op2_license_scan, op4_pii, op5_jaccard, op6_quality, op8_html,
    op10_decontamination,
)
from faultline.llm.common import table
from faultline.llm.queries import queries
from tests.compare import connect, differences

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `group` string"
ODD_TEXTS = [None, "", " \n\t ", "one", "word " * 40_000, "é" * 3000, "a\u0000b \u2028 c"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a NULL id and a column with a name the operators use."""
    rows = [(i, t, None, None, None, "x") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[4], (None, "some words here", *[None] * 4)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}


# -- url filter --------------------------------------------------------------------------------

RULED = [
    ("https://a.net/", "net/", "block"), ("https://a.net", None, None),
    ("HTTP://WWW.Example.NET/en/1?q#f", "example.net/en/", "allow"),
    ("http://badexample.net/en/", "net/", "block"), ("http://example.net/EN/", "net/", "block"),
    ("x://example.com/de/9", "example.com/de/", "block"), ("x://org/fr/", "org/fr/", "allow"),
    ("x://a.b.org/fr", None, None), (None, None, None), ("no address", None, None),
    ("x://net?/", None, None), ("x://h\n.net/\n", "net/", "block"),
]


def test_url_rules_and_edges(spark):
    pages = spark.createDataFrame([(i, u, "p") for i, (u, _, _) in enumerate(RULED)],
                                  "page_id long, url string, host string")
    for r in op1_url_filter.judge_urls(pages).collect():
        _, rule, verdict = RULED[r.page_id]
        assert r.rule == rule
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    parts = {r.page_id: (r.host, r.path) for r in op1_url_filter.judge_urls(pages).collect()}
    assert parts[2] == ("www.example.net", "/en/1") and parts[8] == parts[9] == ("", "")
    assert op1_url_filter.judge_urls(pages.limit(0)).count() == 0
    assert op1_url_filter.judge_urls(pages.union(pages)).count() == 2 * len(RULED)


def test_url_query_matches_plain_scores(spark, sf_dir):
    weights, bias = op1_url_filter.fit(op1_url_filter.labelled_urls())
    found = {r.page_id: r for r in queries()["op1_url_filter"](spark, sf_dir).collect()}
    for page in table(spark, sf_dir, "pages").collect():
        host, path = op1_url_filter.split_url(page.url)
        buckets = op1_url_filter.gram_buckets(host, path)
        z = bias + sum(weights[b] for b in buckets) / len(buckets) ** 0.5
        assert abs(found[page.page_id].score - 1 / (1 + 2.718281828459045 ** -z)) < 1e-6
        assert (found[page.page_id].host, found[page.page_id].path) == (host, path)


def test_url_model_on_unseen_sites():
    rows = op1_url_filter.labelled_urls()
    held = [r for r in rows if zlib.crc32(r[0].split("://")[1].split("/")[0].split(".")[-3].encode()) % 5 == 0]
    weights, bias = op1_url_filter.fit([r for r in rows if r not in held])

    def says(url):
        b = op1_url_filter.gram_buckets(*op1_url_filter.split_url(url))
        return bias + weights[b].sum() / len(b) ** 0.5 > 0
    assert sum(says(u) == bool(y) for u, y in held) / len(held) > 0.7


# -- licences ----------------------------------------------------------------------------------

def test_licence_query_matches_sql(spark, sf_dir):
    assert differences(queries()["op2_license_scan"](spark, sf_dir), connect(sf_dir),
                       op2_license_scan.oracle()) == []


def test_licence_canonical_form(spark, odd, none):
    mit = op2_license_scan.MIT
    variants = [mit, mit.upper(), "// Copyright (c) 2020 Jo\r\n" + mit.replace("\n", "\r\n // "),
                mit.replace("sublicense", "sublicence"), mit.replace(".", " . "), mit + " more"]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(variants)] + [(9, "x\n# released under the MIT licence!\ny")],
        "doc_id long, text string")
    known = op2_license_scan.known_digests(spark)
    rows = {r.doc_id: r for r in op2_license_scan.scan(docs, known).collect()}
    assert [rows[i].whole_licences for i in range(6)] == ["MIT"] * 5 + [""]
    assert (rows[9].whole_licences, rows[9].line_licences) == ("", "MIT")
    assert op2_license_scan.scan(odd, known).count() == odd.count()
    assert op2_license_scan.scan(none, known).count() == 0
    assert op2_license_scan.scan(odd, known.limit(0)).count() == odd.count()


ISC_AS_USUAL = """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""" + op2_license_scan.ISC[op2_license_scan.ISC.index("\n\nTHE"):]
HEADS = ["", "Copyright (c) 2020 Jo\n\n", "Copyright The Foo Authors\n(c) Jo Doe\n\n",
         "/*\n * (C) Copyright Jo\n * © Jo\n * Copyright 2001, Jo\n */\n"]


def test_licence_texts_in_any_wrapping(spark):
    """Lines of a body that begin with the word copyright belong to it."""
    cases = [("ISC", ISC_AS_USUAL)]
    for licence, _, text in op2_license_scan.KNOWN:
        for head in HEADS:
            for width in (20, 33, 47, 60, 72, 76, 80, 100, 10_000):
                body = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False,
                                                 break_on_hyphens=False) for p in text.split("\n\n"))
                cases.append((licence, head + body))
    assert any(re.search("(?mi)^copyright (notice|holders)", t) for _, t in cases[1:])
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)],
                                 "doc_id long, text string")
    rows = op2_license_scan.scan(docs, op2_license_scan.known_digests(spark)).collect()
    assert [cases[r.doc_id] for r in rows if r.whole_licences != cases[r.doc_id][0]] == []
    # Lists with letters and sentences about copyright are no statements.
    plain = ["(c) You must keep this", "copyright holders be liable", "a\nCopyright Jo"]
    kept = spark.createDataFrame([(t,) for t in plain], "text string").select(
        op2_license_scan.canonical(F.col("text"))).collect()
    assert [r[0] for r in kept] == ["c you must keep this", "copyright holders be liable",
                                    "a copyright jo"]


def test_licence_table_covers_texts_headers_and_identifiers(spark):
    rows = op2_license_scan.known_texts()
    whole = {licence for licence, scope, _ in rows if scope == "text"}
    assert whole >= {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0",
                     "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0"}
    apache = op2_license_scan.APACHE_HEADER
    mpl = next(t for k, s, t in rows if (k, s) == ("MPL-2.0", "header") and "http" in t)
    gpl = next(t for k, s, t in rows if (k, s) == ("GPL-2.0-or-later", "header"))
    marked = lambda text, mark: "\n".join(
        (mark + " " + x).rstrip() for p in text.split("\n\n") for x in [*textwrap.wrap(p, 50), ""])
    cases = [
        ("#!/bin/sh\n# Copyright 2020 Jo\n" + marked(apache, "#") + "\nimport os\n", "Apache-2.0"),
        ("package x;\n/*\n * Copyright Jo\n *\n" + marked(apache, " *") + "/\nclass A {}", "Apache-2.0"),
        (marked(gpl, "//").rstrip("/\n ") + "\nint main() {}", "GPL-2.0-or-later"),
        ("/* " + "\n   ".join(textwrap.wrap(mpl, 60)) + " */\nx = 1;", "MPL-2.0"),
        ("<!--\n" + mpl + "\n-->\n<p>x", "MPL-2.0"),
        ("// SPDX-License-Identifier: GPL-3.0-or-later\nx", "GPL-3.0-or-later"),
        ("# SPDX-License-Identifier: GPL-2.0+\nx", "GPL-2.0-or-later"),
        ("x\n/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\nx", "Apache-2.0,MIT"),
        ("a\nThis project is licensed under the GNU Lesser General Public License v2.1.\nb", "LGPL-2.1"),
        ("the GPL and the Apache License, in prose", ""), (apache.split("\n\n")[-1] + "\nx", ""),
    ]
    texts = [(k, t) for k, s, t in rows if s == "text"]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)]
                                 + [(100 + i, t) for i, (_, t) in enumerate(texts)],
                                 "doc_id long, text string")
    found = {r.doc_id: r for r in op2_license_scan.scan(
        docs, op2_license_scan.known_digests(spark)).collect()}
    assert [found[i].line_licences for i in range(len(cases))] == [want for _, want in cases]
    assert [k for i, (k, _) in enumerate(texts) if found[100 + i].whole_licences != k] == []


# -- personal data -----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items()
            for m in re.finditer(p, text) if plain_valid(k, m.group())]


@pytest.fixture(scope="module")
def judge(spark):
    return op4_pii.Judge(spark)


def check_digests(rows, of):
    for r in rows:
        base = plain_spans(of(r))
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        kinds = Counter(s.split(":")[0] for s in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in PLAIN]
        spans = [s for s in r.spans.split(",") if s]
        assert spans[:len(base)] == base
        order = [(op4_pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_pii_query_matches_plain(spark, sf_dir):
    of = texts(spark, sf_dir)
    rows = queries()["op4_pii_spans"](spark, sf_dir).collect()
    assert len(rows) == len(of)
    check_digests(rows, lambda r: of[r.doc_id])


def test_pii_hard_texts(spark, judge, odd, none):
    hard = ["a@b.c_d@e.f", "x@y", "@", "a@b..c", "é😀 jo@x.org 😀 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
            "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (22) 333-4444",
            "+1" + " " * 50_000, "1" * 60_000, "1 " * 30_000, "a" * 60_000, "a.b" * 20_000 + "@c.de",
            "+1 22 333 4444 5555 6666", "1.1" * 20_000, "jo@x.org" * 3_000, "0" * 400 + ".1.1.1"]
    docs = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    check_digests(op4_pii.digests(docs, judge).collect(), lambda r: hard[r.doc_id])
    found = op4_pii.digests(odd, judge).collect()
    check_digests([r for r in found if r.doc_id is not None], lambda r: ODD_TEXTS[r.doc_id] or "")
    assert len(found) == odd.count() and op4_pii.digests(none, judge).count() == 0


def test_pii_trees_on_held_out_spans(judge):
    for kind, (_, _, threshold, p, y) in judge.models.items():
        taken = p >= threshold
        assert y[taken].mean() >= 0.9, kind
        assert taken[y == 1].mean() >= 0.8, kind


def test_pii_redaction(spark, judge):
    docs = spark.createDataFrame(
        [(1, "mail jo@x.org or +1 (222) 333-4444.", 9), (2, None, 0), (3, "nothing 12 here", 15),
         (4, 'my token = "0b3c6a43eb78aa99cbd7049c572391524f37a812" ok', 1)],
        "doc_id long, text string, _spans int")
    rows = {r.doc_id: r for r in op4_pii.redact(docs, judge).collect()}
    assert rows[1].text == "mail [EMAIL] or [PHONE]." and rows[1]._spans == 9
    assert rows[2].text is None and rows[3].text == "nothing 12 here"
    assert rows[4].text == 'my token = "[SECRET]" ok'


def test_pii_numbers_next_to_each_other(spark, judge):
    """Two cards in a row make one run of digits, which is proposed and covered as a whole."""
    rows = spark.createDataFrame([(1, "so 4465758382889437 4465758382889437 ahead")],
                                 "doc_id long, text string")
    assert op4_pii.redact(rows, judge).first().text == "so [NUMBER] ahead"


def test_pii_uses_no_python(spark, judge, odd):
    plan = op4_pii.digests(odd, judge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# -- quality -----------------------------------------------------------------------------------

def test_quality_query(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = queries()["op6_quality_scores"](spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.85


def plain_features(text):
    data = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", data)]
    n, count = len(words), lambda characters: sum(data.count(c.encode()) for c in characters)
    share = lambda value, whole: value / max(whole, 1)
    lines = count("\n")
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(n),
        "mean_word": share(sum(map(len, words)), n),
        "long_words": share(sum(len(w) > 14 for w in words), n),
        "upper": share(count(string.ascii_uppercase), len(data)),
        "digits": share(count(string.digits), len(data)),
        "beyond_ascii": share(sum(b >= 128 for b in data), len(data)),
        "marks": share(count("#$%&*+=@^_~<>\\{}[]"), n), "bars": share(count("|"), n),
        "exclaims": share(count("!?"), n), "stops": share(count("."), n),
        "commas": share(count(",;:"), n),
        "distinct": math.log1p(len(set(words))) / math.log1p(n) if n else 0.0,
        "doubled": share(sum(a == b for a, b in zip(words, words[1:])), n),
        "line_words": math.log1p(n / (1 + lines)), "lines": math.log1p(lines),
    }


def test_quality_scores_match_plain(spark, sf_dir, odd):
    """Features of whole texts, and the score as a sum of looked-up values, one row at a time."""
    documents = table(spark, sf_dir, "documents")
    for docs in (documents, odd):
        want = Counter(tuple(round(plain_features(r.text)[f], 9) for f in op6_quality.FEATURES)
                       for r in docs.collect())
        got = Counter(tuple(round(r[f], 9) for f in op6_quality.FEATURES)
                      for r in op6_quality.feature_rows(docs).collect())
        assert got == want
    rows = op6_quality.feature_rows(documents)
    model = op6_quality.train(rows, table(spark, sf_dir, "labels"))
    scores = {r.doc_id: r.score for r in queries()["op6_quality_scores"](spark, sf_dir).collect()}
    for r in rows.collect():
        bins = [bisect.bisect_right(c.tolist(), r[f]) for c, f in zip(model.cuts, op6_quality.FEATURES)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[bins[i], bins[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_quality_learns_from_no_held_out_label(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(op6_quality.held_out(F.col("doc_id")),
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    as_rows = lambda l: sorted(map(tuple, op6_quality.classify(documents, l).collect()))
    assert as_rows(labels) == as_rows(turned)


def test_quality_sample_has_the_smallest_hashes(spark, sf_dir, monkeypatch):
    """A bounded sample, also of rows that are there twice."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = op6_quality.feature_rows(table(spark, sf_dir, "documents"))
    taken = []
    monkeypatch.setattr(op6_quality, "fit", lambda x, y: taken.extend(map(tuple, x)))
    op6_quality.train(rows.union(rows), labels, 20)
    known = labels.filter(~op6_quality.held_out(F.col("doc_id"))).select("doc_id")
    best = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id")).limit(20)
    assert sorted(taken) == sorted(map(tuple, best.select(*op6_quality.FEATURES).collect()))


def test_quality_edges(spark, sf_dir, odd, none):
    labels = table(spark, sf_dir, "labels")
    rows = op6_quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert op6_quality.classify(none, labels).count() == 0
    assert {r.score for r in op6_quality.classify(odd, labels.limit(0)).collect()} == {0.5}


# -- pages -------------------------------------------------------------------------------------

def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[len(a)][len(b)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=24), st.lists(st.sampled_from("abce"), max_size=24))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    shared = op8_html.shared_lines(a, b)
    kept = [x for x, s in zip(a, shared) if s]
    rest = iter(b)
    assert len(kept) == plain_lcs(a, b) and all(x in rest for x in kept)


PAGES = [
    ("<nav>Menu</nav><article><h1>T &amp;amp; x</h1><p>One  two<b>three</b></p><p>Four</article>"
     "<footer>F</footer>", "T &amp; x\nOne twothree\nFour"),
    ("<p>a<br>b<script>var t='</p>';</script><!-- c --><p>d<div class='ad-box'>buy</div>", "a\nb\nd"),
    ("<div>3 < 5 &lt; 7</div><form>x</form><p hidden>y", "3 < 5 < 7"),
    ("<main><ul><li>a<li>b</ul><aside>no</aside><div id=comments><p>no</div></main><p>out", "a\nb"),
    ("<article><p>x<article class='comment'>no</article></article>", "x"),
    ("<p title='a > b'>q</p><a href=\"x", "q\n<a href=\"x"), (None, ""), ("", ""), ("<!-- open", ""),
    ("plain&nbsp;text", "plain text"), ("<b>" * 5_000 + "deep", "deep"),
]


def test_page_lines(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}/", h, "x") for i, (h, _) in enumerate(PAGES)],
                                  "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in op8_html.main_text(pages).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert (rows[i].text, rows[i].n_chars) == (text, len(text)), i
    assert op8_html.main_text(pages.limit(0)).count() == 0
    assert op8_html.main_text(pages.union(pages)).count() == 2 * len(PAGES)


WRAPPED = [
    ("<div class='content no-sidebar'><p>a</div>", "a"), ("<div class='with-sidebar'>a</div>", "a"),
    ("<div class='has-comments ad-free'><article>a</article></div>", "a"),
    ("<div id='right-sidebar' class='menu-open'><main>a</main></div>", "a"),
    ("<article class='post has-comments'>a</article>", "a"),
    ("<article><h2 id='related-work'>a</h2><h2 id='search-algorithms'>b</h2><h3 id='copyright'>c</h3>"
     "<h2 id=notice-period class=notice>d</h2><p class='notice'>e</article>", "a\nb\nc\nd\ne"),
    ("<h2 id='copyright'>a</h2><div id='site-footer'>x</div><div class='x ad-box-2'>y</div>", "a"),
    ("<main><section id='notice'>a</section><section id='comments'>x</section>"
     "<div class='comment-list'>y</div><div class='share-buttons'>z</div></main>", "a"),
    ("<article class='comment-body'>x</article><div class='cookie_banner'>y</div><p>a", "a"),
    ("<div class='page-header'>x</div><div class='entry-header'>a</div>", "a"),
]


def test_names_count_as_whole_tokens():
    for html, text in WRAPPED:
        assert "\n".join(line for line, _ in op8_html.page_lines(html)) == text, html


def test_shared_lines_of_the_nearest_page_go(spark):
    def page(i, *lines):
        return (i, f"http://h/{'a' if i < 100 else 'b'}/{i:05}", "".join(f"<p>{x}</p>" for x in lines))
    rows = [page(i, "Site", f"story {i}", f"more {i}", "Contact") for i in range(200)]
    rows += [(900, "http://alone/x", "<p>Site</p><p>only</p>"), (901, None, "<p>Site</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = {r.page_id: r.text for r in op8_html.main_text(pages).collect()}
    assert all(found[i] == f"story {i}\nmore {i}" for i in range(200))
    assert found[900] == "Site\nonly" and found[901] == "Site"
    one = {r.page_id: r.text for r in op8_html.main_text(pages.coalesce(1)).collect()}
    assert one == found


def test_copies_and_near_copies_are_looked_past(spark):
    """Runs of copies longer than any block, near copies next door, a page inside its neighbour."""
    def page(i, lines):
        return (i, f"http://h/{i:05}", "".join(f"<p>{x}</p>" for x in lines))
    menu, foot = ["Home", "News"], ["Contact"]
    story = lambda n: [f"{w} of story {n} {w}" for w in ("begin", "middle", "turn", "close")]
    rows, wanted = [], {}

    def add(body, kept):
        wanted[len(rows)] = "\n".join(kept)
        rows.append(page(len(rows), menu + body + foot))
    for i in range(20):
        add(story(f"x{i}"), story(f"x{i}"))
    for _ in range(300):
        add(story("same"), story("same"))
    for i in range(300):
        near = [*story("near")[:3], f"edited {i}"]
        add(near, near)
    add(story("long") + ["an end"], story("long") + ["an end"])
    add(story("long"), story("long"))
    for i in range(3):
        add(story(f"y{i}"), story(f"y{i}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = {r.page_id: r.text for r in op8_html.main_text(pages).collect()}
    assert [i for i in wanted if found[i] != wanted[i]] == []
    # A host of copies alone has nothing to tell its menu by.
    alone = op8_html.main_text(pages.filter("page_id between 100 and 200")).collect()
    assert {r.text for r in alone} == {"\n".join(menu + story("same") + foot)}


def test_difference_tells_which_main_elements_are_the_article(spark):
    """A teaser that the nearest page has too goes; the story stays with the lines it shares."""
    teaser = "<article><h2>Work with us</h2><p>Ten open places</article>"
    rows = [(i, f"http://h/{i:05}", f"<p>own {i}<article><p>Dear all<p>A long story number {i} of {i * 7}"
             f"<p>Thanks</article>" + teaser) for i in range(200)]
    rows += [(200 + i, f"http://only/{i}", f"<p>{'outside ' * 9}{i}<main><p>Same</main>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in op8_html.main_text(pages).collect()}
    assert all(found[i] == f"Dear all\nA long story number {i} of {i * 7}\nThanks" for i in range(200))
    # No element has a line of its own: none can be told apart.
    assert found[200] == found[201] == "Same"
    # A page alone on its host has nothing to be told by.
    alone = op8_html.main_text(pages.filter("page_id = 7")).first()
    assert alone.text.endswith("Work with us\nTen open places")


def test_page_query_keeps_the_article(spark, sf_dir):
    import html
    rows = {r.page_id: r.text for r in queries()["op8_html_text"](spark, sf_dir).collect()}
    for page in table(spark, sf_dir, "pages").collect():
        body = re.search("<article>(.*?)</article>", page.html, re.S).group(1)
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split())
                 for x in re.split("</?(?:p|h1|br)>", body)]
        assert rows[page.page_id] == "\n".join(x for x in lines if x)


def test_difference_matches_plain_on_pages_without_article(spark, sf_dir):
    """The pages of the table without their article tags, on few hosts, some of them copies."""
    rows = []
    for p in table(spark, sf_dir, "pages").orderBy("page_id").limit(120).collect():
        body = re.sub("</?article>", "", p.html)
        site = p.page_id % 5
        head = "".join(f"<p>menu {site} {w}</p>" for w in ("home", "news", "about"))
        for copy in range(1 + 3 * (p.page_id % 7 == 0)):
            edit = f"<p>edit {copy}" if p.page_id % 2 else ""
            rows.append((len(rows), f"http://h{site}.org/{p.page_id // 9}/{p.page_id}/{copy}",
                         head + body + edit))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in op8_html.main_text(pages).collect()}

    read = {i: [t for t, _ in op8_html.page_lines(h)] for i, _, h in rows}
    order = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i) for i, u, _ in rows)

    def other(i, path, places):
        """The first page of other content on the way."""
        for host_path_id in places:
            p, j = host_path_id[1:]
            same = [x for x, s in zip(read[i], op8_html.shared_lines(read[i], read[j])) if s]
            least = min(sum(map(len, read[i])), sum(map(len, read[j])))
            if read[j] and sum(map(len, same)) <= op8_html.COPY_SHARE * least:
                return [(op8_html.common_beginning(path, p), j)]
        return []
    cut_lines = 0
    for at, (host, path, i) in enumerate(order):
        before = [o for o in order[:at][::-1] if o[0] == host]
        after = [o for o in order[at + 1:] if o[0] == host]
        near = other(i, path, before) + other(i, path, after)
        text = read[i]
        if near:
            best = max(near, key=lambda o: o[0])[1]
            text = [x for x, s in zip(text, op8_html.shared_lines(text, read[best])) if not s]
        cut_lines += len(read[i]) - len(text)
        assert found[i] == "\n".join(text), i
    assert cut_lines >= 3 * len(rows) / 2


# -- personal data in long texts ---------------------------------------------------------------

def test_pii_many_spans_match_plain(spark):
    """Offsets and redaction over several blocks of spans, with gaps, doubled and wide characters."""
    parts = [f"é😀 {i} " * (i % 4) + f"user{i}@mail{i % 7}.example.org" + "," * (i % 3) for i in range(700)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text), (2, parts[1]), (3, "")], "doc_id long, text string")
    judge = op4_pii.Judge(spark)
    found = {r.doc_id: r for r in op4_pii.digests(docs, judge).collect()}
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    wanted = [f"email:{m.start()}:{m.end()}" for m in re.finditer(pattern, text)]
    assert found[1].n_email == len(wanted) == 700 and found[3].spans == ""
    assert found[1].base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in op4_pii.redact(docs, judge).collect()}
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in found[1].spans.split(",")))
    out, at = "", 0
    for start, end, kind in spans:
        out += text[at:max(start, at)] + (f"[{kind.upper()}]" if start >= at else "")
        at = max(at, end)
    assert clean[1] == out + text[at:] and "@" not in clean[1]


def test_pii_long_secret_is_proposed(spark):
    """A digit behind more than 64 letters still makes an opaque run a proposal."""
    rows = [(i, 'token = "' + "q" * n + '9kq1z8w7" end') for i, n in enumerate((20, 70, 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = op4_pii.proposals(df, "text").orderBy("doc_id").collect()
    assert [[(s["start"], s["end"]) for s in r.secret] for r in found] == [
        [(9, 9 + n + 8)] for n in (20, 70, 500)]


# -- shingles ----------------------------------------------------------------------------------

def plain_classes(rows):
    sets, low = {}, str.maketrans({c: c + 32 for c in range(65, 91)})
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
        sets[doc] = ({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5
                     else {tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets.items()}


def test_jaccard_query_matches_plain(spark, sf_dir):
    rows = [(d, t) for d, t in texts(spark, sf_dir).items()]
    found = queries()["op5_ngram_jaccard"](spark, sf_dir).collect()
    assert {tuple(r) for r in found} == plain_classes(rows) and len(found) == len(rows)


def test_jaccard_hot_groups(spark, monkeypatch):
    """Small bounds, so that hot shingles, blocks and groups of blocks all occur: a passage in
    many texts, a group of near copies, a chain, and texts that are alike but not linked."""
    monkeypatch.setattr(op5_jaccard, "HOT", 4)
    monkeypatch.setattr(op5_jaccard, "BLOCK", 5)
    word = lambda *k: "w" + hashlib.md5(repr(k).encode()).hexdigest()[:5]
    passage = [word("p", i) for i in range(60)]
    texts_ = []
    for i in range(40):
        texts_.append(passage + [word("own", i, j) for j in range(10 + i % 7)])
        base = [word("near", j) for j in range(120)]
        base[(7 * i) % 120] = word("edit", i)
        texts_.append(base)
        chain = [word("chain", j) for j in range(2 * i, 2 * i + 60)]
        texts_.append(chain)
        alike = [word("alike", j) for j in range(100)]
        for k in range(3):
            alike[(11 * i + 31 * k) % 100] = word("alike", i, k)
        texts_.append(alike)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts_)]
    rows += [(1000, rows[5][1].upper()), (1001, "a b"), (1002, "A  b\n"), (1003, ""), (1004, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op5_jaccard.components(docs).collect()
    assert {tuple(r) for r in found} == plain_classes(rows)


def test_jaccard_lines_of_many_texts_give_no_blocks(spark, monkeypatch):
    """A line that many texts quote is not what they are compared by."""
    monkeypatch.setattr(op5_jaccard, "HOT", 4)
    monkeypatch.setattr(op5_jaccard, "BLOCK", 5)
    hot, blocks = [], op5_jaccard.block_links

    def seen(sets, mixed, *bounds):
        hot.append(mixed.filter(F.col("docs") > 4).count())
        return blocks(sets, mixed, *bounds)
    monkeypatch.setattr(op5_jaccard, "block_links", seen)
    word = lambda *k: "w" + hashlib.md5(repr(k).encode()).hexdigest()[:7]
    line, rows = [word("line", i) for i in range(25)], []
    for i in range(30):
        own = [word("own", i, j) for j in range(80 + i)]
        rows += [(2 * i, " ".join(own + line)), (2 * i + 1, " ".join([word(i), *own, *line]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op5_jaccard.components(docs).collect()
    assert {tuple(r) for r in found} == plain_classes(rows)
    assert hot == [0]


def test_jaccard_parts_add_few_bytes(spark, monkeypatch):
    """With 50 times the parts a shingle costs hardly more bytes, and the counts stay the same."""
    word = lambda *k: "w" + hashlib.md5(repr(k).encode()).hexdigest()[:7]
    rows = [(i << 40, " ".join(word(i % 60, j) for j in range(100))) for i in range(120)]
    rows += [(0, "of one more text with the id of another"), (1, "a b"), (3, "A b"), (2, None),
             (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    sent, deal = [], type(docs).repartition

    def seen(self, *by):
        if "part" in by:
            sent.append(sum(len(v) for r in self.collect() for v in r
                            if isinstance(v, (bytes, bytearray))))
        return deal(self, *by)
    monkeypatch.setattr(type(docs), "repartition", seen)
    counts = []
    for part in (1 << 22, 12_000 // 800):
        monkeypatch.setattr(op5_jaccard, "PART", part)
        counts.append({tuple(r) for r in op5_jaccard.shared_counts(
            docs, op5_jaccard._text_sets, 12_000).collect()})
    least = {(i << 40, 96) for i in range(120)} | {(1, 1), (3, 1)}
    assert counts[0] == counts[1] == least
    assert sent[1] < 9 * 11_520


def test_jaccard_edges(odd, none):
    rows = op5_jaccard.components(odd).collect()
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert found[(0, 0, 0)] == found[(1, 0, 1)] == found[(2, 0, 2)] == 1
    assert found[(3, 1, 3)] == found[(4, 1, 4)] == 2 and found[(None, 1, None)] == 1
    assert len(rows) == odd.count() and op5_jaccard.components(none).count() == 0


# -- decontamination -----------------------------------------------------------------------------

def plain_hits(text, items, window=10):
    find = lambda t: [(m.group().translate({c: c + 32 for c in range(65, 91)}), *m.span())
                      for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    words = [w for w, _, _ in find(text)]
    hit, met = set(), set()
    for item, of in items:
        own = [w for w, _, _ in find(of)]
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = own[i:i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    met.add(str(item))
    return len(words), hit, met


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM"), (3, None),
         (4, ""), (5, "short item"), (12, "Ünï 日本 x9-y8"), (7, "a a a a a a a a a a a a")]
TEXTS = ["zero one TWO three-four five six seven eight nine ten eleven, twelve", "a short  item! shorter",
         "one two three four five six seven eight nine", "Ünï 日本 X9 y8", "a " * 25, None, "", "short",
         "item short item", "ünï 日本 x9 y8"]


def test_contamination_matches_plain(spark, odd, none):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for window in (10, 7, 2, 1):
        for r in op10_decontamination.judged(docs, benchmark, window).collect():
            n, hit, met = plain_hits(TEXTS[r.doc_id], ITEMS, window)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(met), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
    assert [r.doc_id for r in op10_decontamination.clean(docs, benchmark).collect()] == [2, 5, 6, 7, 9]
    assert op10_decontamination.judged(odd, benchmark).count() == odd.count()
    assert op10_decontamination.judged(none, benchmark).count() == 0
    assert op10_decontamination.clean(odd, benchmark.limit(0)).count() == odd.count()


def test_contamination_items_without_id(spark):
    """Their windows hit; the ids listed are those of the others."""
    benchmark = spark.createDataFrame([(1, "one two"), (None, "one two"), (None, "three"), (None, None)],
                                      "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two"), (2, "three"), (3, "four")],
                                 "doc_id long, text string")
    rows = {r.doc_id: (r.n_hit, r.n_items, r.contaminated)
            for r in op10_decontamination.judged(docs, benchmark).collect()}
    assert rows == {1: (2, 1, True), 2: (1, 0, True), 3: (0, 0, False)}
    assert [r.doc_id for r in op10_decontamination.clean(docs, benchmark).collect()] == [3]


def test_contamination_offsets(spark):
    benchmark = spark.createDataFrame([(2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é 😀 a SHORT--item, b short item")], "doc_id long, text string")
    row = op10_decontamination.find_contamination(docs, benchmark).first()
    text = "é 😀 a SHORT--item, b short item"
    assert [text[p["first"]:p["end"]] for p in row.passages] == ["SHORT--item", "short item"]


def test_contamination_anchors_find_every_window():
    """Texts over few words, so that anchors repeat inside items, across items and at borders."""
    import random
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for window in (1, 2, 3, 5, 8, 10):
        items = [(str(i), some(rng.randint(0, 30))) for i in range(12)] + [("x", some(4))] * 2
        matcher = op10_decontamination.Matcher(op10_decontamination.Matcher.facts_of(items, window))
        for _ in range(40):
            text = some(rng.randint(0, 20)) + " z " + rng.choice(items)[1] + some(3)
            n, hit, met = plain_hits(text, items, window)
            words, runs, found = matcher.scan(text)
            assert (words, {w for a, b in runs for w in range(a, b)}, found) == (n, hit, met)


def test_contamination_long_benchmark_is_one_scan(spark):
    """A benchmark of several million characters is one automaton and one pass."""
    items = spark.range(4000).selectExpr(
        "id AS item_id",
        "array_join(transform(sequence(0, 199), i -> concat('w', pmod(hash(id, i), 5000))), ' ') AS text")
    docs = items.filter("item_id % 400 = 7").selectExpr(
        "item_id AS doc_id", "concat('so ', substring_index(text, ' ', 12), ' end') AS text")
    docs = docs.unionAll(spark.createDataFrame([(-1, "w1 w2 w3")], docs.schema))
    found = op10_decontamination.judged(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r.doc_id: (r.n_hit, r.n_items) for r in found.collect()}
    assert rows == {-1: (0, 0), **{i: (12, 1) for i in range(7, 4000, 400)}}


def test_contamination_query_matches_plain_on_all_documents(spark, sf_dir):
    """Every document and every column, by a set of the benchmark's windows."""
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(
        {c: c + 32 for c in range(65, 91)}))
    size, windows = op10_decontamination.WINDOW, {}
    for r in table(spark, sf_dir, "benchmark").collect():
        own = find(r.text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[i:i + size]), set()).add(str(r.item_id))
    lengths = {len(w) for w in windows}
    wanted = []
    for doc, text in texts(spark, sf_dir).items():
        words, hit, met = find(text), set(), set()
        for n in lengths:
            for j in range(len(words) - n + 1):
                if (of := windows.get(tuple(words[j:j + n]))) is not None:
                    hit.update(range(j, j + n))
                    met |= of
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        wanted.append((doc, len(words), len(hit), len(met), digest, bool(hit)))
    rows = queries()["op10_decontamination"](spark, sf_dir)
    assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, rows.collect())) == sorted(wanted)
    assert 0 < sum(r[-1] for r in wanted) < len(wanted)


def test_duckdb_is_here():
    assert duckdb.sql("select 1").fetchall() == [(1,)]
