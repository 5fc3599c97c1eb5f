"""Op 11. URL filters: rules first, then a logistic regression on hashed character n-grams of host and path, in DataFrame functions and Spark's own fit.

The regression is fitted once on a small table of labelled urls and becomes an array of weights in the scoring expression, so judging urls is one pass
without shuffle, join or Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bounded_sample

BUCKETS, SIZES = 1 << 14, (3, 4, 5)
THRESHOLD = 0.7  # a url is blocked from this probability on; above one half, so that names without any known part are left alone
LABELLED_ROWS = 500  # labelled urls that the fit reads at most: it holds their dense vectors, some 64 MB

# A small table of labelled urls, invented for this purpose. Label 1 is to be blocked.
BLOCKED = """
http://buy-cheap-meds.example.com/order https://www.cheap-watches.example.net/replica/sale http://discount-pills.example.org/viagra
http://online-pills-shop.example.com/cialis https://pharmacy-pills.example.net/no-prescription http://cheap-viagra.example.org/buy
http://blog.cheap-flights-deal.example.com/click http://m.casino-bonus.example.net/win http://www.best-casino.example.org/slots/free-spins
https://poker-jackpot.example.com/en/bonus http://bets-and-odds.example.net/win http://slots-casino.example.org/jackpot
http://sports-bets.example.com/en/7 http://win-casino.example.net/de/31 http://free-spins.example.org/fr/102 http://freebets.example.net/es/88
http://spam-links.example.com/seo http://link-farm.example.net/backlinks http://seo-farm.example.org/directory/links
http://spam-blog.example.net/post http://content-farm.example.com/articles/seo http://click-farm.example.org/likes
http://spammy-ads.example.com/banner http://ads-pixel.example.net/track http://adserver-track.example.org/banner/click
http://www.ads-network.example.com/en/512 http://track-pixel.example.net/en/40 http://popup-ads.example.org/de/6
http://click-here-now.example.com/win-prize http://free-prize.example.net/winner http://you-won-iphone.example.org/claim
http://xxx-videos.example.com/free http://hot-porn.example.net/tube http://adult-cams.example.org/live http://m.adult-videos.example.com/en/19
http://sexy-singles.example.com/dating http://porn-tube.example.net/xxx http://adult-dating.example.org/fr/3
http://crack-keygen.example.com/download http://warez-torrent.example.net/full-crack http://free-movies-torrent.example.org/stream
http://fast-loan-cash.example.com/apply http://payday-loans.example.net/cash http://make-money-fast.example.org/rich
http://work-home-cash.example.com/earn http://miracle-diet-pills.example.net/weight-loss http://weight-loss-miracle.example.org/trick
http://secure-login-verify.example.com/account/update http://paypa1-verify.example.net/login http://bank-account-verify.example.org/signin
http://crypto-doubler.example.com/invest http://bitcoin-double.example.net/profit http://forex-profit.example.org/signals
""".split()
ALLOWED = """
http://www.example.com/ http://news.example.net/world/2021/05/12 http://www.daily-herald.example.org/politics/article
http://city-library.example.com/catalogue/books http://www.university.example.net/research/papers http://physics.example.org/lectures/notes
http://docs.example.com/guide/install https://en.encyclopedia.example.net/wiki/History http://wiki.example.org/page/Mathematics
http://art-museum.example.com/collection/paintings http://www.recipes.example.net/bread/sourdough http://rose-garden.example.org/pruning
http://blog.example.com/2020/travel-notes http://blog.jane-doe.example.net/about http://weather.example.org/forecast/berlin
http://child-health.example.com/fever http://www.hospital.example.net/departments http://parliament.example.org/debates/session
http://court.example.com/decisions/2019 http://high-school.example.net/timetable http://m.sports.example.org/football/results
http://forum.example.com/thread/1234 http://answers.example.net/questions/55 http://developer.example.org/api/reference
http://code.example.com/projects/parser http://music.example.net/composers/bach http://film-review.example.org/drama
http://theatre.example.com/season http://www.railway.example.net/stations http://street-maps.example.org/city/lyon
http://statistics.example.com/tables/population http://journal.example.net/volume/12/issue/3 http://archive.example.org/letters/1890
http://church.example.com/parish/history http://village-council.example.net/minutes http://nature.example.org/birds/owl
http://astronomy.example.com/planets/saturn http://chemistry.example.net/elements/iron http://language.example.org/grammar/verbs
http://dictionary.example.com/word/house http://poetry.example.net/sonnets http://fairy-stories.example.org/tales
http://kitchen.example.com/tools http://bicycle.example.net/repair http://mountain.example.org/hiking/trails
http://sailing.example.com/knots http://chess.example.net/openings http://photo.example.org/landscape
http://www.engineering.example.com/bridges http://architecture.example.net/houses http://www.teachers.example.org/lessons
http://theother.example.com/en/12 http://thenation.example.net/en/345?page=2 http://www.thinker.example.org/en/78 http://station.example.com/de/91
http://region.example.net/fr/406 http://blog.nation.example.org/es/57 https://m.weather.example.com/en/684.html http://thread.example.net/fr/9/
""".split()


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Fitted:
    """The weight of each bucket of n-grams and the constant of the logistic regression."""

    weights: tuple[float, ...]
    constant: float


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label: the built-in table."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit("")))


def _grams(text: Column, mark: str) -> Column:
    """Bucket numbers of the n-grams of a marked text, in order; letters are cut once, so the work is in proportion to its length."""

    def windows(letters: Column, size: int) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(letters) - size), lambda i: F.pmod(
            F.xxhash64(F.concat(F.lit(mark), *[F.get(letters, i + k) for k in range(size)])), F.lit(BUCKETS)).cast("int"))
        return F.when(F.size(letters) >= size, hashed).otherwise(F.array().cast("array<int>"))

    bound = F.array(F.split(F.concat(F.lit("<"), text, F.lit(">")), ""))
    return F.get(F.transform(bound, lambda letters: F.concat(*[windows(letters, size) for size in SIZES])), 0)


def features(host: Column, path: Column) -> Column:
    """The different buckets of n-grams in host and path."""
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rows: int = LABELLED_ROWS) -> Fitted:
    """The regression over the labelled urls, or over some ``rows`` of them with the smallest hashes where there are more.

    Label 1 is to be blocked, 0 to be allowed; rows with a null url or label are left out, repeated rows count once. Without rows every url is allowed,
    with one label every url gets that one.
    """
    known = labelled.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{label_col}`").cast("double").alias("label")).dropna().distinct()
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return Fitted((0.0,) * BUCKETS, math.inf if 1.0 in counts else -math.inf)
    known = bounded_sample(known, "url", rows)
    found = F.transform(F.array(features(*split_url(F.col("url")))), lambda f: F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.array_contains(f, b).cast("double")))  # computed once for each url
    held = known.select("url", "label", array_to_vector(F.get(found, 0)).alias("features"))
    # one partition of at most ``rows`` vectors, so that sums do not depend on how the table was cut
    held = held.coalesce(1).sortWithinPartitions("url", "label")
    model = LogisticRegression(regParam=1e-2, maxIter=200, tol=1e-9, standardization=False).fit(held)
    return Fitted(tuple(model.coefficients.toArray().tolist()), float(model.intercept))


def score(host: Column, path: Column, fitted: Fitted) -> Column:
    """The probability that a url is to be blocked."""
    if math.isinf(fitted.constant):
        return F.lit(1.0 if fitted.constant > 0 else 0.0)
    weights = F.expr(f"cast(split('{','.join(map(repr, fitted.weights))}', ',') as array<double>)")  # folded into one constant
    found = F.array(features(host, path))
    total = F.get(F.transform(found, lambda f: F.aggregate(f, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))), 0)
    return 1 / (1 + F.exp(-(total + fitted.constant)))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equally long ones the first by name, blocking ones first); nulls where none does."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict != "block"))

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    none = F.lit(None).cast("string")
    return (F.coalesce(*[F.when(fits(r), F.lit(r.name)) for r in ordered], none), F.coalesce(*[F.when(fits(r), F.lit(r.verdict)) for r in ordered], none))


def judge(df: DataFrame, fitted: Fitted, rules: Sequence[Rule] = (), threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row: the longest fitting rule decides, else whether the score reaches ``threshold``.

    A null url, or one without ``://``, has an empty host and path, which no rule with a host fits. Rows stay as they are, repeated or with a null id;
    an empty table gives no row; other columns go. Rules are a list of some hundred at most: each is a test in the expression.
    """
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    parts = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score(F.col("host"), F.col("path"), fitted).alias("score"))
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
