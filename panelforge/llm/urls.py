"""URL filter: rules on hosts and paths, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Character n-grams of these lengths, hashed to so many buckets.
GRAMS, BUCKETS = (3, 4, 5), 1 << 12
#: The labelled table (fixed values): 1 is a URL to block. Hosts and paths are invented.
LABELLED = """
1 casino-win.example.com/en/12
1 free-bets.example.com/en/310
1 cheap-pills.example.com/en/47
1 ads-track.example.com/fr/9
1 spam-farm.example.com/en/728
1 adult-x.example.net/en/5
1 www.casino-royal-win.example.org/play/bonus
1 best-casino.example.com/slots/jackpot
1 online-bets-free.example.net/bets/today
1 sports-bets.example.org/odds/free-bets
1 pills-online.example.com/buy/cheap-pills
1 cheap-meds.example.org/pharmacy/pills
1 track-ads.example.net/click/ads
1 ads-server.example.com/banner/track
1 link-farm.example.com/spam/links
1 spam-offers.example.org/win/prize
1 adult-video.example.com/xxx/adult
1 adult-x.example.org/gallery/adult-x
1 win-money.example.com/casino/win
1 free-casino.example.net/poker/free
1 cheap-watches.example.com/replica/cheap
1 m.spam-farm.example.org/de/77
1 blog.cheap-pills.example.net/es/3
1 free-bets.example.org/fr/190.html
0 therin.example.com/en/770
0 blog.tiontion.example.com/en/853
0 ththan.example.org/en/960
0 www.ththen.example.com/en/148.html
0 thertion.example.org/es/978
0 m.therou.example.com/en/474.html
0 news.example.com/fr/2021/article
0 library.example.org/de/books/12
0 university.example.edu/en/research
0 docs.example.com/en/guide
0 museum.example.org/es/collection/4
0 weather.example.com/fr/paris
0 recipes.example.com/en/bread
0 forum.example.org/en/thread/88
0 www.garden.example.com/de/pflanzen
0 science.example.org/en/physics
0 history.example.com/en/rome
0 blog.travel.example.com/es/madrid
0 code.example.org/en/tutorial
0 music.example.com/fr/concert
0 health.example.org/en/advice
0 city.example.com/de/rathaus
0 school.example.org/en/lessons
0 maps.example.com/en/route/71
0 thndre.example.org/en/315
0 erbleou.example.com/de/20
"""


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path``; both empty for a url that is null or has no ``://``."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows`` (host, path) with ``rule`` and ``by_rule``: the longest fitting rule's name and verdict, or null."""
    pick = rule = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, pick = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(pick)
    return rows.withColumns({"rule": rule, "by_rule": pick})


def with_grams(rows: DataFrame, host, path) -> DataFrame:
    """``rows`` with ``grams``: the character n-grams of host and path, each marked with where it is from.

    Texts are split into characters once, in columns of their own, so the work grows with their length.
    """

    def of(mark, chars, n):
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - n + 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), *[F.element_at(chars, i + k) for k in range(n)]))

    rows = rows.withColumns({f"_{mark}": F.split(F.concat(F.lit("^"), text, F.lit("$")), "") for mark, text in (("h", host), ("p", path))})
    return rows.withColumn("grams", F.concat(*(of(mark, F.col(f"_{mark}"), n) for mark in "hp" for n in GRAMS))).drop("_h", "_p")


def train(spark: SparkSession, labelled: str = LABELLED):
    """The regression fitted to ``label url`` lines. The table is a constant, so what it takes is bounded."""
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join("({0}D, 'http://{1}')".format(*line.split()) for line in labelled.strip().splitlines()) + " AS t(label, url)")
    data = hashed(with_grams(parsed(rows.coalesce(1)), F.col("host"), F.col("path")))
    return LogisticRegression(maxIter=100, regParam=0.01, featuresCol="features", labelCol="label", predictionCol="p", rawPredictionCol="r", probabilityCol="q").fit(data)


def hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS).transform(rows)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The verdict is the fitting rule's, else the regression's (block from a probability of 0.5). Rows are judged
    one by one, without a shuffle, so hot hosts do no harm. Urls that are null or have no ``://`` have empty parts
    and get the regression's verdict on these. Only page_id and url are read; repeated rows are repeated; an empty
    table gives an empty table.
    """
    rows = ruled(parsed(pages.select("page_id", "url")), rules)
    model = train(pages.sparkSession)
    free = F.col("by_rule").isNull()  # the others need no n-grams
    scored = model.transform(hashed(with_grams(rows, F.when(free, F.col("host")).otherwise(""), F.when(free, F.col("path")).otherwise(""))))
    verdict = F.coalesce("by_rule", F.when(F.col("p") == 1, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
