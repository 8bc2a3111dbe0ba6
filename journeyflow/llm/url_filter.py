"""URL verdicts: rules first, then logistic regression on hashed character n-grams.

Host and path are cut from the url by the contract's rules. A rule fits its host and all of its
subdomains if the path starts with the rule's; the longest one wins (ties: block). All other urls
are judged by a logistic regression on hashed character n-grams of host and path, trained from the
small table of labelled urls below with Spark ML. Scoring is column expressions alone: the
weights are one row with an array of ``DIM`` numbers, joined to every url.

A null url, or one without ``://``, has empty host and path and is judged as such by the model.
Repeated rows and null page_ids are answered one by one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from journeyflow.llm.storage import materialize

#: (host, path) -> verdict; fixed by the contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: The small labelled table the model learns from.
BLOCKED = """
casino-royal.example.com/en/1 www.casino-win.example.net/de/7 blog.lucky-casino.example.com/es/12 online-casino.example.net/fr/3
blog.casino.example.com/en/5.html m.casino-club.example.net/en/8/ m.big-win-casino.example.com/de/2 blog.play-casino.example.net/es/4
free-bets.example.net/en/20 www.sports-bets.example.com/es/6 betting-tips.example.net/fr/4 m.bet-now.example.com/en/9.html
bets-online.example.com/de/5 www.betting.example.net/en/15 free-spins.example.com/fr/11 m.free-cash.example.net/es/2/
poker-room.example.com/en/31 jackpot-slots.example.net/de/8 m.slots-win.example.com/es/9 win-money.example.net/fr/10
cheap-pills.example.com/en/14 blog.cheap-pills.example.net/en/3 pharma-pills.example.com/es/7 viagra-cheap.example.net/de/6
diet-pills.example.com/de/12 cheap-meds.example.net/fr/16 www.cheap-drugs.example.com/en/18.html no-rx-pharma.example.net/es/13
adult-x.example.com/en/5 www.adult-chat.example.net/de/11 xxx-video.example.com/fr/14 m.adult-cams.example.net/es/15
sex-dates.example.net/fr/8 porn-tube.example.com/en/22 www.adult-x.example.net/de/17 blog.hot-adult.example.com/en/25/
ads-track.example.com/fr/2 m.ads-track.example.net/en/44 ad-server.example.com/de/14 tracker-pixel.example.net/es/3
click-ads.example.com/en/28 banner-ads.example.com/fr/7 popup-ads.example.net/en/2 www.track-ads.example.net/de/19
spam-farm.example.com/en/9 www.spam-farm.example.net/es/5 link-farm.example.com/fr/12 mail-spam.example.net/de/9
free-money.example.net/en/33 payday-loans.example.com/es/8 quick-loans.example.net/de/3 get-rich.example.com/en/40
warez-crack.example.net/fr/6 torrent-crack.example.com/en/16 malware-drop.example.net/de/4 phish-login.example.com/es/11
""".split()
ALLOWED = """
www.example.com/en/1 blog.example.net/de/7 example.com/es/12 m.example.net/fr/20 news.example.com/en/24.html
www.library.example.net/es/9 weather.example.com/fr/3 thethe.example.net/en/12 blog.history.example.com/de/31
m.there.example.com/en/5 www.thing.example.net/fr/88 nation.example.com/en/415 station.example.net/es/7
school.example.com/de/2 www.garden.example.net/es/4 museum.example.com/en/8/ blog.travel.example.com/en/77
www.kitchen.example.net/fr/11 m.science.example.com/en/3 cooking.example.com/de/19 reading.example.net/en/60
music.example.com/es/6 www.theater.example.com/en/14 letters.example.net/fr/2 www.winter.example.com/es/30
blog.other.example.com/en/9 www.teaching.example.net/en/52 health.example.com/fr/33 www.hospital.example.net/de/8
m.rather.example.com/de/41 forest.example.net/es/6 www.interest.example.com/en/27 hunting.example.net/de/90
blog.listen.example.net/en/18 www.shelter.example.com/en/70 edition.example.com/fr/5 m.season.example.net/en/61
blog.ordering.example.net/en/4 www.united.example.com/es/85 northern.example.net/en/36 tradition.example.com/en/11
blog.master.example.com/fr/64 m.thousand.example.net/de/22 www.another.example.com/en/13 anthem.example.net/en/95
store.example.com/de/16 www.bread.example.net/en/21 handwriting.example.com/en/17 m.heat.example.com/es/50
blog.theme.example.net/fr/40 www.nature.example.com/en/32.html m.tenth.example.com/de/5/ question.example.net/es/10
trouble.example.com/en/19 www.stable.example.net/de/13 table.example.com/fr/9 bread-and-butter.example.net/en/7
m.mother.example.net/en/23 blog.ocean.example.com/es/14 www.ready.example.com/fr/17 action.example.net/de/26
""".split()

DIM = 1 << 14
HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (3, 4)
PATH_WEIGHT = 0.2  # a path n-gram's value; a host n-gram's is 1


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path after it; both empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.when(rest.isNotNull(), F.substring(url, F.length(rest) + 4, F.length(url)))
    authority = F.regexp_extract(F.coalesce(tail, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(tail, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(authority, upper, upper.lower()), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path``) and its verdict; both null if none does."""
    found = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found, verdict = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(v)).otherwise(verdict)
    return found, verdict


def _grams(text: Column, sizes: tuple[int, ...], tag: str) -> Column:
    """Hashed n-grams of a text between end marks, as an array of places below DIM."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    parts = []
    for n in sizes:
        last = F.size(chars) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, lambda i, n=n: F.pmod(F.xxhash64(F.lit(tag), F.array_join(F.slice(chars, i + 1, n), "")), F.lit(DIM)).cast("int")))
    return F.array_distinct(F.concat(*parts))


def features(host: Column, path: Column) -> list[Column]:
    """Distinct hashed places of a url's host n-grams and of its path n-grams, a run of digits as one 0."""
    plain = F.regexp_replace(path, "[0-9]+", "0")
    return [_grams(host, HOST_GRAMS, "host").alias("hosts"), _grams(plain, PATH_GRAMS, "path").alias("paths")]


def train(spark: SparkSession, penalty: float = 0.002) -> tuple[list[float], float]:
    """Weights and intercept learned from the labelled urls."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = ", ".join(f"('https://{u}', {y}.0D)" for y, table in ((1, BLOCKED), (0, ALLOWED)) for u in table)
    labelled = spark.sql(f"select url, label from values {rows} as t(url, label)")
    labelled = materialize(labelled.select("label", *features(*host_path(F.col("url")))).coalesce(1), "urls")
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.array_contains("hosts", i).cast("double") + PATH_WEIGHT * F.array_contains("paths", i).cast("double"))
    fitted = LogisticRegression(maxIter=60, regParam=penalty, standardization=False).fit(
        labelled.select("label", array_to_vector(dense).alias("features")))
    return fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def judge_urls(pages: DataFrame) -> DataFrame:
    """Per row page_id, host, path, rule, verdict and the model's score (probability to block)."""
    spark = pages.sparkSession
    weights, intercept = train(spark)
    model = materialize(spark.sql("select from_json('" + str([round(w, 8) for w in weights]) + "', 'array<double>') as weights"), "weights")
    host, path = host_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    scored = cut.select("*", *features(F.col("host"), F.col("path"))).crossJoin(F.broadcast(model))  # one row

    def total(places: str) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get("weights", i))

    margin = F.lit(intercept) + total("hosts") + PATH_WEIGHT * total("paths")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return scored.withColumn("score", score).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
