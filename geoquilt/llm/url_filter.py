"""URL filter: host and path rules first, then logistic regression on character n-grams.

The model is fitted on the driver from a small labelled table of urls: hashed n-grams of the
host (with marked ends) and of the path, each weighed by its count in the url of unit length.
Rules are `host/path` strings: one fits its host and all subdomains where the url's path starts
with the rule's path; the longest that fits decides. What no rule fits, the model judges.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case. Path: then up to
`?`, `#` or the end. Null urls and urls without `://` have both empty; the model judges them
from no n-grams, which is the intercept. Every row gives one row, repeated ones too, and an empty
table an empty one; only the url and the columns to carry are read, whatever others are named. Of
equally long rules that fit, the greater as text decides. Urls are judged whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
LENGTHS = (3, 4, 5)
STEPS, RATE, RIDGE = 300, 8.0, 1e-3
THRESHOLD = 0.5
#: Rows of a labelled table that a model is fitted on, at most: the table is meant to be small.
MAX_TRAINING = 20_000

#: A labelled table to start from, of invented addresses: 1 is to be blocked.
SEED_URLS: tuple[tuple[str, int], ...] = (
    ("https://www.cheap-pills.example/buy/online", 1),
    ("http://cheap-meds-pharmacy.example/order-now", 1),
    ("https://viagra-discount.example/pills/50mg", 1),
    ("https://best-casino-bonus.example/slots/free-spins", 1),
    ("http://online-poker-win.example/casino/jackpot", 1),
    ("https://spam-farm.example/en/links", 1),
    ("http://link-farm.example/backlinks/buy", 1),
    ("https://seo-spam.example/backlinks/cheap", 1),
    ("https://xxx-videos.example/porn/free", 1),
    ("http://adult-cams.example/live/xxx", 1),
    ("https://hot-dating-singles.example/join", 1),
    ("http://free-money-fast.example/earn/cash", 1),
    ("https://payday-loans-now.example/apply", 1),
    ("https://crypto-doubler.example/invest/profit", 1),
    ("http://win-free-iphone.example/claim/prize", 1),
    ("https://replica-watches.example/cheap/rolex", 1),
    ("http://torrent-crack-keygen.example/download/serial", 1),
    ("https://malware-download.example/setup.exe", 1),
    ("http://phishing-login.example/verify/account", 1),
    ("https://clickbait-farm.example/shocking/trick", 1),
    ("https://weight-loss-miracle.example/pills/trial", 1),
    ("http://cheap-essays.example/buy/essay", 1),
    ("https://bet-sports-odds.example/bonus", 1),
    ("http://warez-cracks.example/keygen", 1),
    ("http://ads-server.example/track/click", 1),
    ("https://banner-ads.example/popup", 1),
    ("http://track-pixel.example/collect", 1),
    ("https://www.orchard.example/en/harvest", 0),
    ("https://m.theorem.example/proofs/10", 0),
    ("https://thermal.example.org/notes/14", 0),
    ("https://news.example/2021/05/world/story.html", 0),
    ("https://www.daily-times.example/politics/article-1034", 0),
    ("https://blog.gardening.example/en/tomatoes", 0),
    ("http://www.university.example/department/history", 0),
    ("https://library.example/catalogue/item/20", 0),
    ("https://docs.project.example/en/stable/install.html", 0),
    ("https://m.weather.example/forecast/today", 0),
    ("http://museum.example/exhibitions/2019", 0),
    ("https://en.encyclopedia.example/wiki/Biology", 0),
    ("https://forum.cooking.example/topic/88/bread", 0),
    ("https://www.city.example/services/waste", 0),
    ("http://journal.example/articles/volume-3/paper.html", 0),
    ("https://travel.example/guides/lisbon", 0),
    ("https://school.example/lessons/maths/fractions", 0),
    ("https://science.example/en/physics/quanta.html", 0),
    ("http://recipes.example/soup/lentil?page=2", 0),
    ("https://blog.photography.example/de/objektive", 0),
    ("https://www.health-service.example/advice/sleep", 0),
    ("https://books.example/reviews/novels/12", 0),
    ("http://music.example/concerts/autumn", 0),
    ("https://open-data.example/datasets/rivers", 0),
    ("https://parliament.example/debates/2020/03", 0),
    ("https://m.theatre.example/fr/programme", 0),
    ("https://www.railway.example/timetable/north", 0),
)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as the column functions give them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#")[0].split("?")[0]
    name, slash, tail = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name), slash + tail


def rule(name: Column, tail: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(the rule that decides, its verdict), null where none fits. rules: (verdict, host/path)."""
    decided, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones go outside
        at, _, start = text.partition("/")
        fits = ((name == at) | name.endswith(f".{at}")) & tail.startswith(f"/{start}")
        decided = F.when(fits, F.lit(text)).otherwise(decided)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return decided, verdict


def grams(name: str, tail: str) -> np.ndarray:
    """Buckets of all n-grams, repeated as they repeat."""
    out = []
    for kind, text in (("h", f"^{name}$"), ("p", tail)):
        if len(text) > (2 if kind == "h" else 0):
            out += [f"{kind}{text[i : i + n]}" for n in LENGTHS for i in range(len(text) - n + 1)]
    return np.array([xxhash.xxh3_64_intdigest(g) % BUCKETS for g in out], np.int64)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, name: str, tail: str) -> float:
        found = grams(name, tail)
        odds = self.intercept
        if len(found):
            odds += float(self.weights[found].sum()) / np.sqrt(_square(found))
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def _square(found: np.ndarray) -> float:
    return float((np.unique(found, return_counts=True)[1].astype(float) ** 2).sum())


def fit(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Rows without label are ignored; without both labels, scores are their share (0.5: none)."""
    rows = [(u, y) for u, y in rows if y in (0, 1)][:MAX_TRAINING]
    y = np.array([r[1] for r in rows], float)
    share = float(y.mean()) if len(y) else 0.5
    weights = np.zeros(BUCKETS)
    if not len(y):
        return Model(weights, 0.0)
    if not 0 < share < 1:
        return Model(weights, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    found = [grams(*parts(u)) for u, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    column = np.concatenate(found)
    value = np.repeat([1 / np.sqrt(_square(f)) if len(f) else 0.0 for f in found], [len(f) for f in found])
    intercept = float(np.log(share / (1 - share)))
    for _ in range(STEPS):
        odds = intercept + np.bincount(row, weights[column] * value, minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / len(rows)
        weights -= RATE * (np.bincount(column, value * error[row], minlength=BUCKETS) + RIDGE * weights)
        intercept -= error.sum()
    return Model(weights, intercept)


def score(model: Model, name: Column, tail: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, tails in batches:
            yield pd.Series([model.score(n, t) for n, t in zip(names, tails, strict=True)], dtype=float)

    return scored(name, tail)


def judge(urls: DataFrame, carry: list[str], rules: Iterable[tuple[str, str]], model: Model) -> DataFrame:
    """The columns `carry` of urls (url, ...), then host, path, rule, verdict and score. The
    rules become one expression: they are meant to be few."""
    rows = urls.select(*carry, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    decided, verdict = rule(F.col("host"), F.col("path"), list(rules))
    scored = rows.withColumns({"rule": decided, "__said": verdict, "score": score(model, F.col("host"), F.col("path"))})
    judged = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(*carry, "host", "path", "rule", F.coalesce("__said", judged).alias("verdict"), "score")
