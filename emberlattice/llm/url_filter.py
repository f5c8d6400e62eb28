"""URL filters: host and path rules, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlattice.llm.common import ascii_lower

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"))

# The labelled URL table (1: unwanted).
LABELLED = (
    ("https://www.casino-win.example/slots/bonus", 1), ("http://best-casino.example/poker/win", 1),
    ("https://cheap-pills.example/buy/viagra", 1), ("http://pills-discount.example/order/cheap", 1),
    ("https://ads-track.example/click?id=7", 1), ("http://track-ads.example/banner/pop", 1),
    ("https://free-bets.example/odds/sport", 1), ("http://bets-free.example/win/now", 1),
    ("https://spam-farm.example/links/1", 1), ("http://link-farm.example/spam/page", 1),
    ("https://adult-cams.example/live/xxx", 1), ("http://xxx-tube.example/video/hot", 1),
    ("https://loan-fast.example/payday/cash", 1), ("http://cash-loan.example/apply/fast", 1),
    ("https://warez-crack.example/download/keygen", 1), ("http://free-crack.example/serial/key", 1),
    ("https://replica-watch.example/sale/rolex", 1), ("http://coupon-spam.example/deal/free", 1),
    ("https://www.library.example/catalogue/books", 0), ("http://university.example/en/research", 0),
    ("https://museum.example/fr/collection/12", 0), ("http://news.example/en/2024/05/science", 0),
    ("https://wiki.example/article/history", 0), ("http://blog.gardening.example/en/105", 0),
    ("https://docs.example/de/manual/install", 0), ("http://www.weather.example/es/forecast", 0),
    ("https://m.cooking.example/fr/recipes/31.html", 0), ("http://city.example/en/council/minutes", 0),
    ("https://school.example/es/courses/maths", 0), ("http://health.example/en/advice/sleep", 0),
    ("https://forum.example/thread/8151", 0), ("http://www.theatre.example/de/programme/", 0),
    ("https://hotel.example/en/rooms/204", 0), ("http://travel.example/fr/guide/9", 0),
    ("https://blog.letters.example/en/7310", 0), ("http://m.notes.example/es/482", 0),
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams_of(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """Character n-grams of the host and, marked apart, of the path."""
    out = []
    for mark, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))):
        for n in sizes:
            count = F.length(part) - (n - 1)
            gram = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(mark), part.substr(i, F.lit(n))))
            out.append(F.when(count > 0, gram).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


def featurise(urls: DataFrame, url: str, buckets: int, features: str) -> DataFrame:
    grams = f"{features}_grams"
    hashed = HashingTF(inputCol=grams, outputCol=features, numFeatures=buckets, binary=True)
    return hashed.transform(urls.withColumn(grams, ngrams_of(host_of(F.col(url)), path_of(F.col(url))))).drop(grams)


def train_url_model(labelled: DataFrame, url: str = "url", label: str = "label", buckets: int = 1 << 14,
                    penalty: float = 0.01, iterations: int = 50) -> LogisticRegressionModel:
    """Fit on a small labelled table (its size is the bound); rows without url or label are left out."""
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).dropna()
    rows = featurise(rows.repartition(1), "url", buckets, "features")
    return LogisticRegression(regParam=penalty, maxIter=iterations).fit(rows)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host suffix, then path prefix) that fits, as struct(rule, verdict); else null.

    Ties in length are impossible between two fitting rules with one host; otherwise the rule with the
    longer host wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].find("/"))):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(pages: DataFrame, model: LogisticRegressionModel, url: str = "url", rules=RULES,
                threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, block_score and verdict (allow or block).

    A fitting rule decides; else the model blocks at ``threshold`` or more. Row by row, no shuffle. Null
    urls and urls without ``://`` have empty host and path and are judged by the model. Repeated rows
    each get a verdict; input columns with the five names are replaced.
    """
    buckets = model.numFeatures
    with_parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    vector = "_url_features_"
    scored = featurise(with_parts, url, buckets, vector)
    named = {"featuresCol": vector, "probabilityCol": "_url_probability_", "rawPredictionCol": "", "predictionCol": ""}
    model = model.copy({model.getParam(k): v for k, v in named.items()})
    scored = model.transform(scored)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = scored.withColumn("block_score", vector_to_array("_url_probability_")[1])
    return judged.withColumns({
        "rule": rule["rule"],
        "verdict": F.coalesce(rule["verdict"], F.when(F.col("block_score") >= threshold, "block").otherwise("allow")),
    }).drop(vector, "_url_probability_")


def op7_url_filters(pages: DataFrame) -> DataFrame:
    """The verdict of each page row, by the rules and a model of the labelled URL table."""
    model = train_url_model(labelled_urls(pages.sparkSession))
    judged = filter_urls(pages.select("page_id", "url"), model)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))
