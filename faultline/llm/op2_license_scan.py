"""Licence scan: canonical digests of whole texts, joined to the digests of known licences.

Two texts with the same canonical form are the same licence text: case, punctuation, white space,
comment marks, lines that state a copyright and equivalent spellings do not matter. The canonical form of a
document's whole text, of each of its lines and of each of its paragraphs is hashed, so a document
that is a licence, one that carries a licence notice as a line of its own and one whose code stands
below a licence header are all found by the same equality join. Everything is built from SQL
functions.

The known licences are a table (licence, scope, text): scope ``text`` is compared with whole texts,
``notice`` with whole texts and single lines, ``header`` with whole texts and paragraphs. A header
is the paragraph that names the licence. Paragraphs end at lines without words, where block comments open
and close and, in a second reading, where lines with and without a comment mark meet. The table is ``KNOWN`` and the file ``licences.jsonl``
beside this module, read by the driver. Its digests join as an ordinary table, whose size Spark
knows. Identifier expressions count only as far as they stand in the table; a ``+`` after a version
in a line reads as "or later".

Edge cases: a NULL or empty text, or one of copyright lines alone, has the canonical form "" and
no licence; texts that match several known texts list each licence once, sorted; repeated rows
are scanned each; other columns are not read.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, the left one read as the right one, on canonical words.
SPELLINGS = [
    ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"),
    ("licensee", "licencee"), ("licensing", "licencing"), ("sublicense", "sublicence"),
    ("authorization", "authorisation"), ("authorized", "authorised"),
    ("organization", "organisation"), ("organizations", "organisations"),
    ("merchantability", "merchantibility"), ("noninfringement", "non infringement"),
    ("fulfillment", "fulfilment"), ("favor", "favour"), ("behavior", "behaviour"),
    ("whilst", "while"), ("v", "version"), ("https", "http"),
]

# Texts of public licences and the notices by which works refer to them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under
the License."""
KNOWN = [
    ("MIT", "text", MIT),
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("MIT", "text", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", "text", ISC),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("Apache-2.0", "text", APACHE_HEADER),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice",
     "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "SPDX-License-Identifier: CC0-1.0"),
]

# Groups that repeat over lines are possessive: such a loop takes no stack, however many lines.
# A line that states a copyright, after comment marks: with a sign or a year anywhere, with a name
# alone only before the body, at most after a title. Other lines that begin with the word are lines
# of a body that wrap there.
STATED_LINE = (r"(?m)^[ \t/*#;-]*(?:©|&copy;|(?:copyright|\(c\))[ \t:,]*(?:\(c\)|©|&copy;|copyright|"
               r"(?:by[ \t]+)?[0-9]{4}|[\[<{](?:year|yyyy)))[^\n]*$")
NAMED_LINES = (r"\A([\s/*#;-]*+(?:[^\n]{0,40}licen[cs]e[^\n]{0,20}\n[\s/*#;-]*+)?)"
               r"(?:(?:copyright|\(c\))[ \t:,]+(?!(?:notices?|holders?|owners?|laws?|statements?|"
               r"licen[cs]\w*|interests?|protection|permission|and|or|in|of|is|on|to|you|as)\b)"
               r"[^\n]*+[\s/*#;-]*+)++")
# The SQL twin's pattern: every line that begins so. Equal on texts whose body has no such line.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(copyright|\(c\)|©)[^\n]*$"
NOT_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
# Every known notice and header holds this, so lines and paragraphs without it need no digest.
NOTICE_MARK = "licen"
# Between paragraphs: lines without words and the marks of a block comment; after a ``#!``. Also
# where lines with and without a comment mark meet.
NO_WORDS = r"\n(?:[ \t/*#;!<>-]*+\n)++"
SHEBANG = r"\A#![^\n]*"
BLOCK_OPENS = r"\n([ \t]*(?:/\*|<!--))"
BLOCK_CLOSES = r"((?:\*/|-->)[ \t]*\n)"
COMMENT_ENDS = r"(?m)^([ \t]*(?:[/*#;-]|<!)[^\n]*\n)(?=[ \t]*[^ \t/*#;<\n-])"
CODE_ENDS = r"(?m)^([ \t]*[^ \t/*#;<\n-][^\n]*\n)(?=[ \t]*(?:[/*#;]|--|<!))"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r",
                       "abcdefghijklmnopqrstuvwxyz\n")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words joined by single spaces, one spelling each."""
    def chosen(word: Column) -> Column:
        spelling = word
        for other, one in SPELLINGS:
            spelling = F.when(word == other, F.lit(one)).otherwise(spelling)
        return spelling

    text = F.regexp_replace(F.regexp_replace(lowered(text), STATED_LINE, ""), NAMED_LINES, "$1")
    words = F.split(F.trim(F.regexp_replace(text, NOT_WORD, " ")), " ")
    return F.array_join(F.transform(words, chosen), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


@cache
def known_texts() -> list[tuple[str, str, str]]:
    """The table of known licences: KNOWN and the rows of the data file."""
    with Path(__file__).with_name("licences.jsonl").open(encoding="utf-8") as lines:
        rows = [json.loads(line) for line in lines]
    return KNOWN + [(r["licence"], r["scope"], r["text"]) for r in rows]


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(scope, digest, licences) of the known texts; licences is a sorted list in one string."""
    known = known_texts() if known is None else known
    for _, scope, text in known:
        if scope in ("notice", "header") and NOTICE_MARK not in text.lower():
            raise ValueError(f"a {scope} must hold {NOTICE_MARK!r}: {text!r}")
    table = spark.createDataFrame(known, "licence string, scope string, text string")
    licences = F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences")
    return (table.withColumn("digest", digest(F.col("text")))
            .groupBy("scope", "digest").agg(licences))


def pieces(text: Column) -> Column:
    """The lines of a text as notices and its paragraphs as headers: an array of (scope, piece)."""
    def of(scope: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p.contains(NOTICE_MARK)),
                           lambda p: F.struct(F.lit(scope).alias("scope"), p.alias("piece")))

    low = lowered(text)
    lines = F.split(F.regexp_replace(low, r"([0-9])\+(?=\s|$)", "$1 or later"), "\n")
    bare = F.regexp_replace(low, SHEBANG, "")
    bare = F.regexp_replace(F.regexp_replace(bare, BLOCK_OPENS, "\n\n$1"), BLOCK_CLOSES, "$1\n")
    parted = F.regexp_replace(F.regexp_replace(bare, COMMENT_ENDS, "$1\n"), CODE_ENDS, "$1\n")
    paragraphs = F.array_union(F.split(bare, NO_WORDS), F.split(parted, NO_WORDS))
    return F.concat(of("notice", lines), of("header", paragraphs))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Per document row: doc_id, digest of the canonical text, ``whole_licences`` of the text as
    a whole and ``line_licences`` of its lines and, for headers, its paragraphs; each a sorted
    comma-joined list, empty if none."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    one_list = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(
        F.collect_list(F.split(c, ","))))), ",")
    of_text = known.groupBy("digest").agg(one_list("licences").alias("whole"))
    of_piece = known.filter(F.col("scope").isin("notice", "header")).select(
        "scope", F.col("digest").alias("piece_digest"), "licences")

    # Rows with the same id and the same text have the same pieces; the pair is their key.
    row = [F.col("doc_id"), F.xxhash64("text").alias("row_hash")]
    found_pieces = (texts.filter(lowered(F.col("text")).contains(NOTICE_MARK))
                    .select(*row, F.inline(pieces(F.col("text"))))
                    .select("doc_id", "row_hash", "scope", digest(F.col("piece")).alias("piece_digest")))
    by_line = (found_pieces.join(of_piece, ["scope", "piece_digest"]).groupBy("doc_id", "row_hash")
               .agg(one_list("licences").alias("by_line")))
    whole = texts.select(*row, digest(F.col("text")).alias("digest"))
    found = whole.join(of_text, "digest", "left")
    same = found["doc_id"].eqNullSafe(by_line["doc_id"]) & (
        found["row_hash"] == by_line["row_hash"])
    return found.join(by_line, same, "left").select(
        found["doc_id"], "digest",
        F.coalesce("whole", F.lit("")).alias("whole_licences"),
        F.coalesce("by_line", F.lit("")).alias("line_licences"))


def oracle(known=None) -> str:
    """DuckDB SQL for the same rows over the view ``documents``, where no document holds a licence
    of the data file alone and no line of a text's body
    begins with the word copyright or (c): this form takes every such line out."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spelling = " ".join(f"when {quote(a)} then {quote(b)}" for a, b in SPELLINGS)

    def canon(text: str) -> str:
        low = (f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), "
               "'abcdefghijklmnopqrstuvwxyz' || chr(10))")
        bare = f"regexp_replace({low}, {quote(COPYRIGHT_LINE)}, '', 'g')"
        one = f"trim(regexp_replace({bare}, {quote(NOT_WORD)}, ' ', 'g'))"
        return (f"array_to_string(list_transform(string_split({one}, ' '), "
                f"lambda w: case w {spelling} else w end), ' ')")

    values = ", ".join(f"({', '.join(map(quote, row))})" for row in (known or KNOWN))
    return f"""
    with known as (select licence, scope, sha256({canon('text')}) as digest
                   from (values {values}) as t(licence, scope, text)),
    texts as (select row_number() over () as r, doc_id, text from documents),
    whole as (select r, doc_id, text, sha256({canon('text')}) as digest from texts),
    lines as (select r, unnest(string_split(translate(text, chr(13), chr(10)), chr(10))) as line
              from texts),
    by_line as (select r, string_agg(distinct licence, ',' order by licence) as found
                from lines join known on scope = 'notice' and digest = sha256({canon('line')})
                where line ilike '%{NOTICE_MARK}%' group by r),
    by_text as (select digest, string_agg(distinct licence, ',' order by licence) as found
                from known group by digest)
    select doc_id, digest, coalesce(by_text.found, '') as whole_licences,
           coalesce(by_line.found, '') as line_licences
    from whole left join by_text using (digest) left join by_line using (r)
    """
