"""URL filter: logistic regression on hashed character n-grams of host and path, trained from a small labelled table."""

from __future__ import annotations

import random
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NGrams, Rows, descend, sigmoid, table


@dataclass(frozen=True)
class UrlParams:
    low: int = 3
    high: int = 5
    bits: int = 16
    l2: float = 1e-5
    steps: int = 300
    rate: float = 0.05
    threshold: float = 0.6


#: Words of unwanted hosts, each with what it is joined to; none of these hosts comes from the test tables.
_BAD = {
    "casino": "royal vegas lucky grand club online24", "slots": "jackpot mega hot spin vegas", "poker": "online room pro stars tables", "bet": "sport 365 live king zone", "bets": "sport horse daily vip live", "betting": "odds live tips football24", "roulette": "live euro spin", "lotto": "win mega euro", "jackpot": "city daily big",
    "pills": "diet shop blue rx weight", "viagra": "store online generic", "cialis": "store online buy", "pharmacy": "cheap rx online24 noscript", "steroids": "buy shop", "spam": "links mail blast post", "spammer": "mail king", "seo": "backlinks spam rank1", "linkfarm": "big auto", "backlinks": "buy cheap 1000",
    "ads": "banner server click pop serve media", "adserver": "fast my", "adtrack": "pixel my", "tracker": "click pixel user ad", "tracking": "pixel click ad", "popunder": "net max", "popup": "ads max", "adult": "video chat cams tube dating", "xxx": "tube video movies hot", "porn": "hd tube free4u site", "sex": "cams chat shop live", "nude": "pics cams", "escort": "girls city", "hentai": "tube hd",
    "payday": "loans cash fast", "loans": "quick fast noscore", "cash": "easy fast instant", "rich": "getquick fast", "crypto": "doubler giveaway pump", "bitcoin": "doubler giveaway", "prize": "claim free winner", "winner": "lucky iphone claim", "giveaway": "iphone free card", "replica": "bags watches shoes", "fake": "watches id passport", "warez": "crack zone", "keygen": "crack serial", "crack": "serial soft", "torrent": "free movies", "malware": "drop load", "phish": "login bank", "hack": "account coins",
}
_GOOD = """news dailynews wiki library university college museum history science physics biology chemistry research archive
journal press gazette herald times weather travel recipes kitchen garden health hospital school education teacher books
reading poetry music orchestra theatre cinema sports football cycling running parks nature birds forest ocean climate
energy engineering software docs developer opensource linux python data maps city council government parliament law court
economy market finance bank insurance family parenting children crafts photography camera painting gallery design
architecture house repair tools cars trains aviation space astronomy planets language grammar dictionary translation forum
community people stories essays letters theory method lessons""".split()
#: Joined to the words above, some of them close to unwanted ones, so that a part of a word doesn't condemn a host.
_NEAR = "the my our local open world old new farm track winter window freedom adulteducation betterhomes sussex essexcounty advent address shadow readers links server click club online live daily video shop store free cheap card login".split()
_SYLLABLES = [c + v for c in "b c d f g h j k l m n p r s t v w z st tr br th sh pl".split() for v in "aeiou"]
_SEPARATORS = ("", "-")
_PATHS = ("", "/", "/en/4821", "/de/77", "/fr/19382.html", "/es/6610/", "/index.html", "/a/b", "/item/305", "/page/2")
_BAD_PATHS = ("/buy-pills-now", "/casino/bonus", "/xxx/video1", "/bets/today", "/adult/chat", "/ads/click", "/track/pixel.gif", "/porn", "/viagra-offer", "/spam/links")
_GOOD_PATHS = ("/article/2021/story", "/wiki/history-of-science", "/docs/install", "/blog/travel-notes", "/recipes/bread", "/about", "/contact", "/lessons/grammar", "/news/local", "/research/papers")


def _hosts() -> list[tuple[str, int]]:
    out = [(word, 1) for word in _BAD] + [(word, 0) for word in _GOOD]
    for i, (word, more) in enumerate(_BAD.items()):
        for k, other in enumerate(more.split()):
            sides = (other, word) if (i + k) % 3 else (word, other)
            out.append((_SEPARATORS[(i + k) % 2].join(sides), 1))
    for i, word in enumerate(_GOOD):
        for k in range(3):
            other = _NEAR[(i * 3 + k * 7) % len(_NEAR)]
            out.append((_SEPARATORS[(i + k) % 2].join((other, word) if (i + k) % 3 else (word, other)), 0))
    rng = random.Random(5)  # names that mean nothing are no sign of an unwanted host
    for _ in range(150):
        out.append(("".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((2, 3, 3, 4)))) + rng.choice(("", "n", "r", "s", "x", "t", "rd", "nt")), 0))
    return list(dict.fromkeys(out))


def training_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if unwanted). Each host comes with the same paths, so that only words count."""
    out = []
    for i, (host, label) in enumerate(_hosts()):
        prefix, top = ("", "www.", "m.", "blog.")[i % 4], ("example.com", "example.net", "example.org")[i % 3]
        out += [(f"https://{prefix}{host}.{top}{_PATHS[(i + k) % len(_PATHS)]}", label) for k in (0, 3, 7)]
    for label, paths in ((1, _BAD_PATHS), (0, _GOOD_PATHS)):
        out += [(f"http://{('site', 'portal', 'page', 'my', 'home')[i % 5]}.example.com{p}", label) for i, p in enumerate(paths)]
    return out


def host_and_path(url: str | None) -> str:
    """Lower-cased host without port, user and a leading www., then the decoded path; query and fragment don't count.
    '' where there is no URL; a string that doesn't parse stands for itself."""
    if not url or not url.strip():
        return ""
    url = url.strip()
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").removeprefix("www.")
        return f"^{host}$" + unquote(parts.path).lower()
    except ValueError:
        return url.lower()


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    grams: NGrams

    def probability(self, url: str | None) -> float | None:
        text = host_and_path(url)
        if not text:
            return None
        f = self.grams.distinct(text)
        return float(sigmoid(np.array([self.weights[f].sum(dtype=np.float64) / np.sqrt(max(len(f), 1)) + self.bias]))[0])


def fit(rows: list[tuple[str, int]], params: UrlParams = UrlParams()) -> UrlModel:
    """Classes count alike. With one class only (or no rows) every probability is 0."""
    grams = NGrams(params.low, params.high, params.bits)
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(1 << params.bits, np.float32), -60.0, grams)
    features = [grams.distinct(host_and_path(u)) for u, _ in rows]
    scale = np.array([1 / np.sqrt(max(len(f), 1)) for f in features])
    data = Rows(features, 1 << params.bits)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def gradient(w: np.ndarray) -> np.ndarray:
        g = (sigmoid(data.dot(w[:-1]) * scale + w[-1]) - y) * share
        return np.append(data.back(g * scale) + params.l2 * w[:-1], g.sum())

    w = descend(gradient, len(data.used) + 1, params.steps, params.rate)
    return UrlModel(data.full(w[:-1]), float(w[-1]), grams)


def classify(pages: DataFrame, training: DataFrame | None = None, params: UrlParams = UrlParams()) -> DataFrame:
    """(page_id, url, score, drop) for every row of pages; training has (url, unwanted), a small table that is
    collected; None takes the one that comes with the library.

    Null and blank URLs have a null score and aren't dropped; null training rows don't count; a tie with the threshold
    is dropped. Repeated rows are scored each; texts count whole, however long. Other columns are ignored; an empty table gives an empty result."""
    rows = training_urls() if training is None else sorted((r["url"], int(r["unwanted"])) for r in training.where("url IS NOT NULL AND unwanted IS NOT NULL").select("url", "unwanted").collect())
    held = pages.sparkSession.sparkContext.broadcast(fit(rows, params))  # 2**bits floats, whatever the corpus

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return pd.Series([held.value.probability(u) for u in urls], dtype="float64")

    scored = pages.select("page_id", "url", score("url").alias("score"))
    return scored.select("page_id", "url", "score", F.coalesce(F.col("score") >= params.threshold, F.lit(False)).alias("drop"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE: dict[str, str] = {}
