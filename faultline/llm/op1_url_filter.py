"""URL filter: rules first, then a logistic regression on hashed character n-grams.

Features are the 3- to 5-grams of the host (with its borders marked) and, hashed apart from them,
of the path with every digit read as 0, each weighted by one over the root of their number. The
model is fitted from a small labelled table of at most ``MAX_LABELLED`` URLs; the tasks score rows
with its weight vector, whose size is ``2**BITS`` numbers whatever the input.

Edge cases: a NULL url, or one without ``://``, has an empty host and path, fits no rule and gets
the score of the intercept alone; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import lower_ascii

BITS = 14
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000

# Rules as (verdict, host and path); the path is what follows from the first slash.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/")]

# The labelled table: site names by label, spread over the endings and paths below.
BLOCKED_SITES = """casino-win casino-bonus lucky-casino online-casino poker-stars-free slots-jackpot
sports-betting bet-win free-spins roulette-online cheap-pills buy-pills-online pills-discount
viagra-cheap pharma-discount cheap-meds no-prescription weight-loss-pills spam-farm link-farm
seo-links buy-backlinks article-spinner content-farm click-farm traffic-bot adult-cams xxx-videos
sex-dating hot-singles escort-girls porn-tube replica-watches fake-rolex cheap-handbags
free-iphone win-prize prize-winner lottery-win get-rich-quick easy-money payday-loans quick-loans
crypto-doubler free-bitcoin forex-signals warez-download cracked-software keygen-free
torrent-movies free-movies-hd malware-cleaner registry-fix essay-writing-cheap""".split()
ALLOWED_SITES = """harbour-news city-library river-museum oak-school maple-university physics-notes
open-data weather-report garden-journal cooking-recipes travel-diary history-archive math-lectures
linux-kernel python-guide health-service town-council parliament chess-club bird-watch
film-review book-review poetry-corner music-school orchestra football-club cycling-tours
mountain-huts rail-timetable ferry-lines bakery-street coffee-house wood-workshop pottery-studio
astronomy-club geology-survey botany-atlas zoo-keeper ocean-research climate-data energy-agency
court-reports legal-aid tax-office post-office bus-lines local-paper daily-herald evening-post
science-weekly medical-journal patient-guide nurse-forum teacher-net student-union alumni
thornton sheridan rothman anderson whitehead brighton northen eastern western southern hanover
theodor reinhard antoine moreau garcia lorente schreiber lindner petit dubois""".split()
SUBDOMAINS = ["", "www.", "blog.", "m."]
ENDINGS = ["example.com", "example.org", "example.net"]
PATHS = ["/en/12", "/de/345/", "/fr/67.html", "/es/890"]


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table: (url, 1 to block). Subdomain, ending and path vary alike for
    both labels, so only the site names tell them apart."""
    rows = []
    for label, sites in ((1, BLOCKED_SITES), (0, ALLOWED_SITES)):
        for i, site in enumerate(sites):
            for j in range(4):
                rows.append((f"https://{SUBDOMAINS[(i + j) % 4]}{site}.{ENDINGS[(i + j) % 3]}"
                             f"{PATHS[(i // 3 + j) % 4]}", label))
    return rows


# -- url parts and rules -----------------------------------------------------------------------

def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``, and from there up to a query or fragment."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, found, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        its_host, slash, rest = text.partition("/")
        fits = (host == its_host) | host.endswith(f".{its_host}")
        fits = fits & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


# -- model -------------------------------------------------------------------------------------

def split_url(url: str | None) -> tuple[str, str]:
    """The plain form of ``url_parts`` for the labelled table."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + path


def gram_buckets(host: str, path: str) -> list[int]:
    path = "".join("0" if c in "0123456789" else c for c in path)
    grams = []
    for mark, text in (("h", f"^{host}$" if host else ""), ("p", path)):
        grams += [mark + text[i:i + n] for n in GRAMS for i in range(len(text) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace")) & ((1 << BITS) - 1) for g in grams]


def fit(labelled: list[tuple[str, int]], l2: float = 0.003, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, intercept) by gradient descent with momentum; the same for the same table."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls")
    weights, bias = np.zeros(1 << BITS), -1.0
    rows, columns, values = [], [], []
    for i, (url, _) in enumerate(labelled):
        buckets = gram_buckets(*split_url(url))
        rows += [i] * len(buckets)
        columns += buckets
        values += [len(buckets) ** -0.5] * len(buckets)
    if not labelled:
        return weights, bias
    rows, columns, values = np.array(rows, int), np.array(columns, int), np.array(values)
    y = np.array([label for _, label in labelled], float)
    speed, bias_speed = np.zeros_like(weights), 0.0
    for _ in range(steps):
        z = bias + np.bincount(rows, values * weights[columns], minlength=len(y))
        error = 1 / (1 + np.exp(-z)) - y
        slope = np.bincount(columns, values * error[rows], minlength=len(weights)) / len(y)
        speed = 0.9 * speed - 2.0 * (slope + l2 * weights)
        bias_speed = 0.9 * bias_speed - 0.5 * error.mean()
        weights, bias = weights + speed, bias + bias_speed
    return weights, float(bias)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None,
               labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict and the model's score (1: block)."""
    weights, bias = fit(labelled_urls() if labelled is None else labelled)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        out = np.empty(len(host))
        for i, (h, p) in enumerate(zip(host, path)):
            buckets = gram_buckets(h, p)
            total = weights[buckets].sum() * len(buckets) ** -0.5 if buckets else 0.0
            out[i] = 1 / (1 + np.exp(-(bias + total)))
        return pd.Series(out)

    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return (parts.withColumn("score", score("host", "path"))
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, by_model).alias("verdict"), "score"))
