"""URL filters: host and path rules, then logistic regression on hashed character n-grams, in built-in functions only.

The weights come from a small labelled table of URLs, fitted by stochastic gradient steps that one SQL aggregate folds over
a single row; that row of ``buckets`` + 1 numbers is all that reaches the driver. Scoring is a fold over a URL's n-grams.

Defined cases: a null URL, or one without ://, has an empty host and path and takes the model's verdict on the empty text;
a null page_id stays null; repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Verdict, host, path; a rule fits its host, the subdomains, and paths that start with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled table: hosts with a path, as lists of those to be blocked and of ordinary ones.
BLOCKED = """
buy-viagra-now.example.net/order  discount-pills.example.org/rx  online-pharmacy-rx.example.com/cart  cheap-meds.example.net/buy  diet-pills-fast.example.com/slim  pill-store.example.org/cialis
casino-royal-bonus.example.net/play  online-casino.example.org/slots  lucky-slots.example.com/spin  mega-win.example.net/jackpot  win-big-casino.example.com/join  poker-win.example.org/table
sport-bets.example.net/odds  best-bets-online.example.com/tips  free-spins.example.org/claim  live-betting.example.com/bets  roulette-free.example.net/play  bingo-bonus-free.example.org/now
adult-videos.example.com/watch  adult-chat.example.net/cam  xxx-movies.example.org/hot  hot-adult-dating.example.net/meet  x-rated-clips.example.com/watch  sexy-cams.example.org/live  adult-club-x.example.org/join  porn-tube-x.example.net/v
spam-mailer.example.net/list  bulk-spam.example.com/send  spam-links.example.org/seo  link-farm.example.net/out  content-farm.example.com/spin  article-farm-seo.example.org/post  like-farm.example.net/buy  farm-of-links.example.org/go
ads-server.example.com/click  click-ads.example.net/r  ad-tracker.example.org/pixel  track-clicks.example.com/go  ads-and-trackers.example.org/t  popup-ads.example.net/show  banner-track.example.com/img  tracking-pixel-ads.example.net/p
free-iphone-prize.example.net/claim  win-prize.example.com/now  free-gift-card.example.org/get  cheap-watches.example.net/replica  cheap-handbags.example.org/buy  cheap-loans.example.com/apply
payday-loans-now.example.net/cash  quick-cash-free.example.org/apply  make-money-fast.example.com/join  crypto-doubler.example.net/send  free-bitcoin-win.example.org/mine  get-rich-quick.example.com/how
warez-downloads.example.net/get  crack-keygen-free.example.org/download  torrent-movies-free.example.com/get  cheap-software-keys.example.net/buy  serial-crack.example.com/key  free-followers.example.org/buy
m.casino-bonus.example.org/de/77  www.cheap-tabs.example.net/fr/12  blog.adult-stories.example.com/es/5  www.free-slots-win.example.org/en/9  m.ads-click.example.net/en/301  www.spam-blog.example.net/de/44
casino-night-win.example.org/en/61  www.casino-online-win.example.com/fr/18  blog.spin-casino.example.org/en/5  win-casino-cash.example.net/es/7  farm-spam.example.com/en/90  www.seo-farm-spam.example.org/de/31
spam-content-farm.example.net/fr/8  m.farm-clicks.example.com/en/15  adult-pics-x.example.com/en/20  www.x-adult.example.net/es/66  m.xxx-adult-zone.example.com/fr/41  adult-only-x.example.net/de/3
pills-cheap-rx.example.org/en/11  www.cheap-pharmacy.example.com/en/47  blog.pills-online.example.net/es/29  ads-network-track.example.org/en/52  www.track-ads.example.com/de/36  m.ad-click-track.example.net/fr/7
bets-today.example.com/en/14  www.free-bet-tips.example.net/en/23  m.win-free-bet.example.org/es/88  casino.example.net/en/play/  pills.example.com/en/buy  freebets.example.org/en/3
onlinecasino.example.com/fr/9  cheappills.example.net/de/12  spammers.example.org/en/4  adultcams.example.net/en/6  clicktracker.example.com/en/8  winbig.example.org/es/2
"""
ORDINARY = """
docs.example.org/en/guide  www.library.example.net/catalogue/77  blog.gardening.example.com/en/12.html  news.city.example.org/fr/2024  m.weather.example.net/de/101  www.university.example.org/research/papers
wiki.history.example.com/es/article  museum.example.net/en/collection/  blog.theatre.example.com/en/7198  river.example.com/en/18815.html  www.cooking.example.net/recipes/soup  m.travel.example.org/es/44508/
school.example.com/fr/1066.html  www.nature.example.net/en/46174  blog.science.example.org/en/4490  forum.code.example.com/questions/3  archive.example.org/en/texts/9  health.example.net/en/advice/21
www.parliament.example.org/de/reden/5  music.example.com/fr/albums/8  northern.example.net/en/5  www.together.example.org/de/19  motion.example.com/en/880  blog.further.example.net/fr/17
m.station.example.org/es/31  www.reason.example.com/en/4  thunder.example.net/de/8  anthem.example.org/en/70  blog.others.example.com/en/9  m.another.example.net/en/3
www.nation.example.net/fr/6  lantern.example.com/en/12  western.example.org/es/4.html  m.leather.example.com/de/55  blog.stone.example.net/en/71  www.bread.example.org/en/900
orchard.example.com/fr/13  www.bridge.example.net/en/41/  m.harbour.example.org/en/8  blog.winter.example.com/de/2  painter.example.net/es/60  www.question.example.com/en/14
mountain.example.org/en/5  blog.reading.example.net/fr/16  m.writing.example.com/en/27  www.learning.example.org/de/38  table.example.net/en/49  cable.example.com/es/50
www.notes.example.org/en/61  blog.letters.example.com/fr/72  m.answer.example.net/en/83  heather.example.org/de/94  www.shore.example.com/en/105  blog.wheat.example.net/en/116
open-source.example.org/en/about  www.city-library.example.com/en/opening-hours  blog.long-walks.example.net/en/44  new-york.example.org/en/map  www.self-study.example.com/fr/5  north-sea.example.net/de/9
well-being.example.com/en/12  www.rail-way.example.org/es/3  blog.home-made.example.net/en/7  m.half-marathon.example.com/en/2  e-learning.example.org/de/8  www.co-operative.example.net/en/6
garden.example.org/en/210  www.forest.example.net/fr/33  blog.ocean.example.com/es/71  m.island.example.org/de/14  valley.example.net/en/85.html  www.meadow.example.com/en/6021/
theory.example.org/en/18  www.thesis.example.net/en/27  blog.method.example.com/fr/3  m.author.example.org/es/92  weather.example.net/en/40  www.brother.example.com/de/15
father.example.org/en/3301  www.mother.example.net/en/77  blog.sister.example.com/en/801  m.children.example.org/fr/64  teacher.example.net/es/5  www.student.example.com/en/1200.html
nationwide.example.org/de/61  www.relation.example.net/en/432  blog.education.example.com/en/19  m.translation.example.org/en/2100  tradition.example.net/fr/8  www.exhibition.example.com/es/306
kitchen.example.org/en/57  www.window.example.net/en/9000  blog.furniture.example.com/de/23  m.carpenter.example.org/en/11  workshop.example.net/en/460/  www.pottery.example.com/fr/70
windmill.example.org/en/35  www.adulthood-studies.example.net/en/2  blog.farmers-market.example.com/en/81  m.organic-farm.example.org/de/6  fishing.example.net/en/12  www.shepherd.example.com/en/209
hospital.example.org/en/visit  www.pharmacist-school.example.net/en/4  blog.statistics.example.com/en/31  m.railway-tracks.example.org/en/17  treadmill.example.net/es/44  www.freedom.example.com/fr/28
sherlock.example.org/en/1  www.northwest.example.net/de/72  blog.southern.example.com/en/66  m.eastern.example.org/es/9  ethnology.example.net/en/83  www.rhythm.example.com/en/54
"""
LABELLED = tuple((u, 1) for u in BLOCKED.split()) + tuple((u, 0) for u in ORDINARY.split()) + (("", 0),)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def host_of(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null; of equally long ones the first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of the text between marks; the empty text has none."""
    marked = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    of = lambda n: F.transform(F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(marked, i, F.lit(n)))
    return F.when(F.length(text) > 0, F.concat(*map(of, sizes))).otherwise(F.array().cast("array<string>"))


def _buckets(host: Column, path: Column, n: int, sizes: tuple[int, ...]) -> Column:
    """Bucket numbers of the n-grams of host and path, which are hashed apart. Digits of the path become one sign."""
    bucket = lambda part: lambda g: F.pmod(F.xxhash64(F.lit(part), g), F.lit(n)).cast("int")
    plain = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(F.transform(_grams(host, sizes), bucket(0)), F.transform(_grams(plain, sizes), bucket(1)))


def fit(spark: SparkSession, labelled=LABELLED, buckets: int = 1024, sizes: tuple[int, ...] = (2, 3), epochs: int = 40, rate: float = 2.0, decay: float = 1e-4) -> list[float]:
    """Weights of the buckets, then the bias. The examples are one row's array, blocked and ordinary ones in turn."""
    sides = [[e for e in labelled if e[1] == y] for y in (1, 0)]
    labelled = sorted(labelled, key=lambda e: (sides[1 - e[1]].index(e) / len(sides[1 - e[1]]), e[1]))
    split = [(u.partition("/")[0], "/" + u.partition("/")[2].partition("?")[0] if "/" in u else "", y) for u, y in labelled]
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(float(y)).alias("y")) for h, p, y in split])

    def example(r: Column) -> Column:
        share = lambda b: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.size(F.filter(b, lambda g: g == i)) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")))
        x = _let(_buckets(r["host"], r["path"], buckets, sizes), share)
        return F.struct(F.concat(x, F.array(F.lit(1.0))).alias("x"), r["y"].alias("y"))

    def step(w: Column, e: Column) -> Column:
        z = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        error = e["y"] - 1 / (1 + F.exp(-z))
        return _let(error, lambda err: F.zip_with(w, e["x"], lambda a, b: a * (1 - decay) + rate * err * b))

    zero = F.array_repeat(F.lit(0.0), buckets + 1)
    passes = F.sequence(F.lit(1), F.lit(epochs))
    folded = _let(F.transform(rows, example), lambda every: F.aggregate(passes, zero, lambda w, _: F.aggregate(every, w, step)))
    return spark.range(1).select(folded.alias("w")).first().w


def score(host: Column, path: Column, weights: list[float], sizes: tuple[int, ...] = (2, 3)) -> Column:
    """The model's probability that the URL is to be blocked."""
    w = F.array(*map(F.lit, weights[:-1]))
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-(_let(_buckets(host, path, len(weights) - 1, sizes), mean) + weights[-1])))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, **how) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, probability (of the model, whichever decides)."""
    weights = fit(pages.sparkSession, **how)
    parts = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    p = score(F.col("host"), F.col("path"), weights, how.get("sizes", (2, 3)))
    ruled = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), p.alias("probability"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("probability") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "probability")
