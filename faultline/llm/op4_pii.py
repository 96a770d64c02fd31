"""Personal data: generators propose spans, boosted trees judge them, thresholds select.

Four generators with validators (email, ip, card, phone) give the base spans, which are always
redacted. Three more propose with high recall whatever may be personal: ``handle`` (addresses
written out, "jo (at) example (dot) org"), ``number`` (digits in groups) and ``secret`` (opaque
runs with digits). Their spans may overlap one another; they are sought outside the base spans.
Gradient-boosted trees over features of the format and of the context turn each into a
probability, and a threshold per kind, set on held-out rows, selects what is redacted.

The trees are fitted on the driver from a labelled table of a few hundred spans made by rule. They
become one SQL expression, so the documents are handled by SQL functions alone, row by row and
without a shuffle.

Offsets are code points. Patterns are possessive and begin at the border of a run, so their time
is proportional to the text, and no pattern recurses. Spans are handled in blocks, so that the time
for a text of many spans is nearly in proportion to them. ``secret`` proposes runs that hold a digit
anywhere; runs of letters alone are words and are not proposed.

Edge cases: a NULL or empty text has no spans; equal spans of two kinds are two spans; repeated
rows are handled each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base kinds in the order in which spans are listed. The patterns find what the
# plain ones (in the comments) find: a run's first character decides for the whole run, so others
# need no try, unless a match ended inside the run (\G).
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "handle": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?"
               r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
    "number": r"[+(]?[0-9][0-9 ()./-]{5,}[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+",
}
KINDS = [*BASE, *PROPOSED]
BEFORE, AFTER = 24, 8

SPAN = "struct<start: int, `end`: int, value: string, before: string, after: string>"


# Spans are folded in blocks of so many: a fold copies what it has, so one over all spans of a text
# would take the square of their number.
FOLDED = 128


def bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once, however often the body looks at it."""
    return F.transform(F.array(value), body)[0]


def blocks_of(items: Column) -> Column:
    """An array cut into arrays of ``FOLDED``, in order."""
    last = (F.greatest(F.size(items) - 1, F.lit(0)) / FOLDED).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda b: F.slice(items, b * FOLDED + 1, F.lit(FOLDED)))


# -- spans of a pattern --------------------------------------------------------------------------

def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``df`` with a column per pattern: its matches in order, each with its offsets and the text
    around it. Offsets follow from the lengths of the matches and of the text between them."""
    kinds = list(patterns)
    df = df.withColumns({f"_m_{k}": F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))
                         for k in kinds})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, patterns[k], -1))
                         for k in kinds})
    none = f"array<{SPAN}>"

    def spans(k: str) -> Column:
        n = F.size(f"_m_{k}")
        steps = F.arrays_zip(F.slice(f"_g_{k}", F.lit(1), n).alias("gap"),
                             F.col(f"_m_{k}").alias("value"),
                             F.slice(f"_g_{k}", F.lit(2), n).alias("next"))

        def grow(state, step):
            gap, value = step["gap"], step["value"]
            start = state["at"] + F.length(gap)
            end = start + F.length(value)
            found = F.struct(start.alias("start"), end.alias("end"), value.alias("value"),
                             F.right(gap, F.lit(BEFORE)).alias("before"),
                             F.left(step["next"], F.lit(AFTER)).alias("after"))
            return F.struct(end.alias("at"),
                            F.concat(state["out"], F.array(found).cast(none)).alias("out"))

        def moved(state, block):
            spans = F.transform(block["out"], lambda s: F.struct(
                (state["at"] + s["start"]).alias("start"), (state["at"] + s["end"]).alias("end"),
                *[s[c].alias(c) for c in ("value", "before", "after")]))
            return F.struct((state["at"] + block["at"]).alias("at"),
                            F.concat(state["out"], F.array(spans)).alias("out"))

        def empty(kind):
            return F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(
                f"struct<at: int, out: {kind}>")

        folded = bound(steps, lambda all_: F.flatten(F.aggregate(
            F.transform(blocks_of(all_), lambda block: F.aggregate(block, empty(none), grow)),
            empty(f"array<{none}>"), moved, lambda state: state["out"])))
        return F.when(n > 0, folded).otherwise(F.array().cast(none))

    df = df.withColumns({k: spans(k) for k in kinds})
    return df.drop(*[f"_{c}_{k}" for c in "mg" for k in kinds])


# -- validators ------------------------------------------------------------------------------------

def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def add(total, place):
        d = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(place % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_IP = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    digits = digits_of(value)
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def with_base(df: DataFrame, text: str) -> DataFrame:
    df = with_matches(df, text, BASE)
    return df.withColumns({k: F.filter(k, partial(valid, k)) for k in BASE})


def laid_over(text: Column, spans: Column, cover) -> Column:
    """``text`` with ``cover(span, its part of the text's length)`` in place of the spans, which
    are in the order of their starts; of overlapping spans the first gives the cover."""
    def block(state, part):
        begin = state["at"]
        stop = F.greatest(begin, F.array_max(F.transform(part, lambda s: s["end"])))

        def step(piece, so_far, span):
            at, start, end = so_far["at"], span["start"], span["end"]
            between = F.substring(piece, at - begin + 1, F.greatest(start - at, F.lit(0)))
            more = F.greatest(end - F.greatest(at, start), F.lit(0))
            return F.struct(F.greatest(at, end).alias("at"), F.concat(
                so_far["out"], between, cover(span, start >= at, more)).alias("out"))

        # The text up to the end of the block's spans, cut out once.
        laid = bound(F.substring(text, begin + 1, stop - begin), lambda piece: F.aggregate(
            part, F.struct(begin.alias("at"), F.lit("").alias("out")), partial(step, piece)))
        return bound(laid, lambda done: F.struct(
            done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return bound(spans, lambda all_: F.aggregate(
        blocks_of(all_), nothing, block, lambda s: F.concat(
            F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))))


def in_order(kinds) -> Column:
    """All spans of the kinds as (start, end, kind), by start."""
    def named(kind: str, span: Column) -> Column:
        return F.struct(span["start"].alias("start"), span["end"].alias("end"),
                        F.lit(kind).alias("kind"))
    return F.array_sort(F.concat(*[F.transform(k, partial(named, k)) for k in kinds]))


# -- features --------------------------------------------------------------------------------------

WORDS_BEFORE = {
    "phone_word": r"(?:tel|telephone|phone|call|fax|mobile|cell|whatsapp|text|reach|dial)\W*(?:me|us|no|number|at|on|is)?\W*$",
    "id_word": r"(?:ssn|social security|passport|iban|account|acct|licen[cs]e|tax id|identity|id card|born|birth)\W*(?:card|no|number|is|on|of)?\W*$",
    "card_word": r"(?:card|visa|amex|mastercard|credit|debit|cc)\W*(?:no|number|is)?\W*$",
    "secret_word": r"(?:token|secret|password|passwd|pwd|key|auth|credential|bearer)\W*$",
    "plain_word": r"(?:version|isbn|page|order|invoice|total|price|population|year|since|from|in|sha|commit|build|file|ticket|ref|chapter|section)\W*$",
}


def feature_columns(c: Column) -> dict[str, Column]:
    """Numbers about a proposed span's format and context."""
    value, before, after = c["value"], F.lower(c["before"]), c["after"]
    count = lambda chars: F.length(value) - F.length(F.translate(value, chars, ""))
    digits = digits_of(value)
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    return {
        "length": F.length(value), "digits": F.length(digits), "spaces": count(" "),
        "hyphens": count("-"), "dots": count("."), "slashes": count("/"), "plus": count("+"),
        "brackets": count("()[]{}"), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))),
        "hex": flag(value.rlike("^[0-9a-f]+$")),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits).cast("int")).otherwise(0),
        "id_shape": flag(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "phone_shape": flag(value.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$")),
        "date_shape": flag(value.rlike(
            r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}|[0-9]{4}[-/][0-9]{4})$")),
        "marked_at": flag(value.rlike(r"[(\[{]at[)\]}]")), "spelled_dot": flag(value.contains("dot")),
        "known_end": flag(F.lower(value).rlike("[ .)\\]}](?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$")),
        "glued": flag(before.rlike(r"[a-z0-9_$€#.,/-]$")),
        "goes_on": flag(after.rlike(r"^[A-Za-z0-9_%€$/-]")),
        "quoted": flag(before.rlike("[\"'=:]\\s*[\"']?$")),
        **{name: flag(before.rlike(words)) for name, words in WORDS_BEFORE.items()},
    }


def proposals(df: DataFrame, text: str) -> DataFrame:
    """A column per proposing generator with its spans and a struct of their features."""
    df = with_matches(df, text, PROPOSED)
    return df.withColumns({k: F.transform(k, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        F.struct(*[v.cast("double").alias(n) for n, v in feature_columns(c).items()]).alias("f")))
        for k in PROPOSED})


# -- labelled table --------------------------------------------------------------------------------

def _fill(pattern: str, seed: int) -> str:
    """``pattern`` with 9 as a digit, x as a hex digit and w as a letter or digit, all by rule."""
    out, state = [], seed * 2654435761 + 12345
    for c in pattern:
        state = (state * 1103515245 + 12345) % 2**31
        pick = state >> 8
        out.append(str(pick % 10) if c == "9" else "0123456789abcdef"[pick % 16] if c == "x"
                   else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[pick % 62]
                   if c == "w" else c)
    return "".join(out)


# (kind, label, what stands before, patterns, what stands after)
TEMPLATES = [
    ("number", 1, ["call me at ", "Phone: ", "tel. ", "my mobile is ", "fax ", "reach us on "],
     ["(999) 999-9999", "999-999-9999", "999.999.9999", "0999 9999999", "030 99999999",
      "(0999) 999 9999", "099 99 99 99 99"], [" thanks", ".", ", or write"]),
    ("number", 1, ["SSN: ", "social security number ", "ssn is "], ["999-99-9999", "999 99 9999"],
     [".", " and", ","]),
    ("number", 1, ["passport no. ", "account number ", "IBAN ", "tax id "],
     ["999999999", "9999 9999 9999 99", "99999999999"], [".", " at the bank"]),
    ("number", 1, ["credit card ", "my visa is ", "card number: "],
     ["9999 999999 99999", "9999-999999-99999", "9999 9999 9999 9999"], [".", " exp"]),
    ("number", 0, ["version ", "since ", "from ", "in ", "page ", "the years ", "about ", "on "],
     ["1999-2009", "1999/2000", "2099-09-09", "09.09.2099", "9 999 999", "99.999.999", "9.99.999.9"],
     [" people", ".", " and", " euros", "%"]),
    ("number", 0, ["ISBN ", "order ", "invoice ", "ticket ", "total ", "and the "],
     ["978-9-99-999999-9", "9999999999", "99999999", "9999999999999", "999 999.99"],
     [".", " units", "-A", " shipped"]),
    ("number", 0, ["the word ", "img_", "v", "de la ", "#"],
     ["9999999999999999", "99999999999999", "9999999", "3.14159999", "99/999/9999/9"],
     [" the", "", "_x", ","]),
    ("secret", 1, ['token = "', "api_key: ", "password=", "secret = '", "Bearer ", 'auth key="'],
     ["x" * 40, "x" * 32, "w" * 24, "w9wwwww9www9wwwwwwwwwww", "sk_wwww9wwwww9wwwwwwwww"],
     ['"', "'", " ", ""]),
    ("secret", 0, ["commit ", "sha ", "file ", "see ", "build ", "the page ", "part "],
     ["x" * 40, "release-2099-09-09-rc9", "IMG_20990909_999999", "chapter9_section99_page99",
      "a-very-long-title-of-99-words", "path/to/some/file9/index"], [" in", ".", ","]),
    ("handle", 1, ["write to ", "contact: ", "mail "],
     ["wwwww (at) example (dot) org", "wwww.www [at] example.com", "wwwww at example dot com",
      "w.wwww{at}mail.example.net", "wwww9 (at) mail9.example.com"], [" soon", ".", ""]),
    ("handle", 0, ["we ", "they ", "it ", "", "you "],
     ["look at example.com", "met at noon.then", "arrived at 9.99", "sold at 99.99",
      "laugh at it.and", "stay at home.9", "wwww at wwww.wwwww", "wwwww at www.www"],
     [" pm", " we", ""]),
]


def labelled_spans() -> list[tuple[int, str, int, str]]:
    """The labelled table: (row, kind, label, text); every proposed span of the kind in the text
    has the label."""
    rows = []
    for kind, label, before, patterns, after in TEMPLATES:
        for i, lead in enumerate(before):
            for j, pattern in enumerate(patterns):
                for m in range(2):
                    text = (f"so {lead}{_fill(pattern, len(rows) + 1)}"
                            f"{after[(i + j + m) % len(after)]}")
                    rows.append((len(rows), kind, label, text))
    return rows


# -- boosted trees -----------------------------------------------------------------------------------

def fit_trees(x: np.ndarray, y: np.ndarray, count: int = 40, depth: int = 3, rate: float = 0.2,
              l2: float = 1.0) -> tuple[float, list]:
    """(intercept, trees); a tree is a value or (feature, bound, tree up to it, tree beyond it)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), base), []

    def grow(rows, g, h, left):
        best = (1e-6, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        for f in range(x.shape[1]) if left else ():
            values = np.unique(x[rows, f])
            for bound in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= bound
                a, b = rows[low], rows[~low]
                gain = (g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2)
                        - whole)
                if gain > best[0]:
                    best = (gain, f, float(bound))
        if best[1] is None:
            return rate * float(g[rows].sum() / (h[rows].sum() + l2))
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(count):
        p = 1 / (1 + np.exp(-total))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        total += np.array([tree_value(tree, row) for row in x])
    return base, trees


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_column(tree, names: list[str], f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, bound, low, high = tree
    return (F.when(f[names[feature]] <= bound, tree_column(low, names, f))
            .otherwise(tree_column(high, names, f)))


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest probability of a half or more from which on the held-out rows are right often
    enough, moved half way to the next lower one."""
    for bound in np.unique(p[p >= 0.5]):
        taken = p >= bound
        if y[taken].mean() >= precision:
            below = p[p < bound]
            return max(0.5, float((bound + (below.max() if len(below) else 0)) / 2))
    return 1.0


class Judge:
    """Trees and thresholds per kind, fitted from a labelled table."""

    def __init__(self, spark: SparkSession, labelled=None, precision: float = 0.97):
        labelled = labelled_spans() if labelled is None else labelled
        table = spark.createDataFrame(labelled, "row int, kind string, label int, text string")
        found = proposals(table, "text").collect()
        self.names = list(feature_columns(F.struct(*[F.lit("").alias(n) for n in
                                                     ("value", "before", "after")])))
        self.models = {}
        for kind in PROPOSED:
            rows = [(r["row"], r["label"], [c["f"][n] for n in self.names])
                    for r in sorted(found, key=lambda r: r["row"]) if r["kind"] == kind for c in r[kind]]
            held = np.array([r % 4 == 3 for r, _, _ in rows])
            y = np.array([label for _, label, _ in rows], float)
            x = np.array([f for _, _, f in rows])
            base, trees = fit_trees(x[~held], y[~held])
            total = base + np.array([sum(tree_value(t, f) for t in trees) for f in x[held]])
            p = 1 / (1 + np.exp(-total))
            self.models[kind] = (base, trees, calibrated_threshold(p, y[held], precision))
            self.models[kind] += (p, y[held])

    def selects(self, kind: str, span: Column) -> Column:
        base, trees, threshold = self.models[kind][:3]
        values = [tree_column(t, self.names, span["f"]) for t in trees]
        total = reduce(lambda a, b: a + b, values, F.lit(base))
        return total >= (float(np.log(threshold / (1 - threshold))) if threshold < 1 else np.inf)


# -- the operator ------------------------------------------------------------------------------------

def with_spans(df: DataFrame, text: str, judge: Judge) -> DataFrame:
    """``df`` with an array column per kind in ``KINDS``: its selected spans, by start."""
    df = with_base(df, text)
    covered = laid_over(F.col(text), in_order(BASE), lambda s, fresh, n: F.repeat(F.lit("\u0001"), n))
    some = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in BASE])
    df = df.withColumn("_rest", F.when(some, covered).otherwise(F.col(text)))
    df = proposals(df, "_rest").drop("_rest")
    return df.withColumns({k: F.filter(k, partial(judge.selects, k)) for k in PROPOSED})


def listed(kinds) -> Column:
    """The spans as kind:start:end, by kind and start, joined by commas."""
    def written(kind: str, span: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), span["start"].cast("string"),
                           span["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(k, partial(written, k)) for k in kinds]), ",")


def digests(documents: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Per document row: doc_id, the number of base spans of each kind, the digest of the base
    spans and the list of all spans."""
    texts = documents.select(F.col("doc_id").cast("long"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = with_spans(texts, "_text", judge or Judge(documents.sparkSession))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def redact(documents: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``documents`` with every selected span of the text replaced by its kind in brackets. A
    NULL text stays NULL; texts without spans stay as they are."""
    names = documents.columns
    work = documents.select(F.struct(*[documents[c] for c in names]).alias("_row"),
                            F.coalesce(documents["text"].cast("string"), F.lit("")).alias("_text"))
    found = with_spans(work, "_text", judge or Judge(documents.sparkSession))
    found = found.withColumn("_spans", in_order(KINDS))
    covered = laid_over(F.col("_text"), F.col("_spans"), lambda s, fresh, n: F.when(
        fresh, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    text = F.when(F.size("_spans") > 0, covered).otherwise(F.col("_row")["text"])
    return found.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names])
