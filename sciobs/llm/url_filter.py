"""Operator 5: URL filters: host and path rules, and a classifier of URLs.

Where no rule fits, a logistic regression on hashed character n-grams of host
and path decides; it is trained from a small labelled table of URLs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: (rule, verdict): a host that includes its subdomains, then the beginning of a path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Hashed n-grams: sizes, buckets; at most so many labelled URLs are used.
GRAMS, BUCKETS, MOST = (3, 4, 5), 1 << 14, 20_000
EPOCHS, RATE, DECAY = 300, 0.1, 1e-5

#: Topics of sites that a corpus leaves out, and of sites that it wants; the second list has many that contain parts of the first.
BAD_TOPICS = """casino poker roulette blackjack slots betting sportsbook jackpot lottery bingo gambling sweepstakes porn xxx sex adult nude camgirls webcams escorts
    hentai erotic fetish viagra cialis pills steroids painkillers weightloss replica fakewatches knockoffs warez cracks keygen serials nulled torrents cheats aimbot
    spam linkfarm backlinks traffic-exchange clickbait popunder adserver adclick banners clicktracker adtracker payday quickcash easyloans freemoney getrich doubler
    forexsignals binaryoptions pumpcoins prizes winner giveaway rewards freegifts singles hookup dating milfs phishing malware botnet followers likes diplomas essaymill
    miracle-cure detox psychic spellcaster""".split()
GOOD_TOPICS = """library museum university school college academy science physics chemistry biology history geography archive journal news weather climate garden recipes
    cooking kitchen travel hiking music orchestra theatre film cinema books poetry painting gallery design architecture engineering software docs developer compiler
    database research laboratory hospital health clinic medicine nursing parliament city council government law court economy finance bank insurance market farming
    forest river ocean mountain island bridge railway airport bicycle football tennis chess puzzle toys family children parenting pets horses birds insects flowers trees
    energy solar water recycling charity community church festival heritage craft pottery knitting woodwork photography camera radio television podcast blog forum wiki
    encyclopedia dictionary language translation maps atlas astronomy space telescope statistics mathematics geometry philosophy psychology sociology education teaching
    students careers jobs business bookstore bakery restaurant hotel tourism camping sailing fishing skiing running yoga dance ballet opera essex sussex middlesex
    therapist pharmacology pharmacist analysis classic assistant cocktail alphabet betterment address admiral advice adventure adulthood hackathon crackers tracks
    railtracks linking slotcar timeslot spelling dates update candidate mandate signals moneybox primary lotus bingley pokerfish sextant sexton winery
    prizewinning crackling serialport torrential cheating-prevention banner-making clicker followup likely diplomacy diploma essays miracles spellings exchange""".split()
#: What stands around topics on either side.
BEFORE, AFTER = ["", "", "best-", "the", "my", "online-", "city-", "world-", "free-", "top"], ["", "", "-online", "hub", "-world", "24", "-club", "zone", "-today", "s"]
ENDS = ["com", "net", "org", "info", "de", "fr", "io", "co.uk"]
PATHS = ["/", "", "/en/12", "/index.html", "/about", "/fr/7?page=2", "/2021/05/a-day-out", "/article/381#top", "/de/3/", "/products/list.php?id=9", "/blog/why", "/p/442"]
SITES_A_TOPIC = 8


def seed_urls() -> list[tuple[str, int, str]]:
    """The small labelled URL table, (url, label: 1 blocks, site): topics of both kinds in the same surroundings, by rule."""
    out = []
    for label, topics in ((1, BAD_TOPICS), (0, GOOD_TOPICS)):
        for i, topic in enumerate(topics):
            for j in range(SITES_A_TOPIC):
                k = 31 * i + 17 * j
                site = f"{BEFORE[k % 10]}{topic}{AFTER[(k // 3 + j) % 10]}"
                sub = ("", "www.", "m.", "blog.", "shop.")[(i + j) % 5]
                out.append((f"{'https' if k % 3 else 'http'}://{sub}{site}.{ENDS[(i + 3 * j) % 8]}{PATHS[(5 * i + j) % 12]}", label, site))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``, ``#`` or the end. Null or without ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. Of equal rules the first counts."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(dict(reversed(rules)).items(), key=lambda r: len(r[0])):
        site, _, start = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def hashed(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of `^host$` and of `^path$`, and the row it belongs to; hosts and paths hash apart."""
    buckets, owners = [], []
    for part, texts in enumerate((hosts, paths)):
        raw = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
        sizes = np.array([len(r) for r in raw])
        b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(len(raw)), sizes)
        for n in GRAMS:
            if len(b) < n:
                continue
            h = np.full(len(b) - n + 1, 7 * part + n, np.uint32)
            for i in range(n):
                h = (h ^ b[i : len(b) - n + 1 + i]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            inside = row[: len(b) - n + 1] == row[n - 1 :]
            buckets.append((h[inside] * np.uint32(0x9E3779B1)) >> np.uint32(18))
            owners.append(row[: len(b) - n + 1][inside])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(buckets or none).astype(np.int64), np.concatenate(owners or none)


def probabilities(hosts: list[str], paths: list[str], weights: np.ndarray) -> np.ndarray:
    if not hosts:
        return np.zeros(0)
    bucket, row = hashed(hosts, paths)
    many = np.maximum(1, np.bincount(row, minlength=len(hosts)))
    z = np.bincount(row, weights[bucket], len(hosts)) / np.sqrt(many) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: DataFrame, most: int = MOST) -> np.ndarray:
    """Weights for every bucket and a bias, from (url, label) rows, at most ``most`` of them by hash order. Null labels are left out; without two labels the prior remains."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1)).orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(most).collect()
    weights, y = np.zeros(BUCKETS + 1), np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        weights[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return weights
    bucket, row = hashed([r["host"] for r in rows], [r["path"] for r in rows])
    value = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    # both labels count alike, however many URLs have them
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    m1, m2 = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, weights[bucket] * value, len(y)) + weights[-1]
        e = (1 / (1 + np.exp(-z)) - y) * share
        grad = np.append(np.bincount(bucket, e[row] * value, BUCKETS) + DECAY * weights[:-1], e.sum())
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad**2 - m2)
        weights -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return weights


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(url, label) for url, label, _ in seed_urls()], "url string, label int")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, url: str = "url") -> DataFrame:
    """The rows of pages with host, path, rule, p_block and verdict (which replace columns of these names).

    The longest fitting rule decides (rule is null where none fits); otherwise
    the classifier blocks from a probability of one half on. Null URLs and URLs
    without ``://`` have an empty host and path and are judged by the classifier.
    Repeated rows are judged each; URLs of any length are read whole.
    """
    spark = pages.sparkSession
    shared.prepare(spark)
    weights = train(labelled if labelled is not None else seeds(spark))

    @F.pandas_udf("double")
    def blocks(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(probabilities(hosts.to_list(), paths.to_list(), weights))

    host, path = host_and_path(F.col(url))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "p_block": blocks("host", "path"), "__verdict": verdict})
    learned = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("__verdict", learned)).drop("__verdict")
