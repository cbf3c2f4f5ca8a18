"""URL filters: rules first, then logistic regression on hashed character n-grams.

The model is Spark ML's: n-grams of host and path are hashed to a fixed number of features and
a logistic regression is fitted on a small labelled URL table. Everything runs in the JVM and
without a shuffle, so the cost is one narrow pass over the url column.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and gets
the model's verdict for empty strings; repeated rows each get their row; urls of any length are read
whole; rules of equal length that fit give the smaller text; columns other than the key and the url are
not read; an empty table gives an empty result. The labelled table is the caller's; ``labelled_urls`` is
a small one of common themes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.llm.common import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: Themes of the small labelled table that comes with the module: hosts named after the first are unwanted, after the second wanted.
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "bets", "betting", "roulette", "pills", "viagra", "pharma", "adult", "xxx", "porn", "sexcam", "escort",
    "spam", "linkfarm", "ads", "adserver", "clicktrack", "popunder", "malware", "phishing", "warez", "torrents", "payday", "replica",
)
WANTED = (
    "news", "weather", "library", "museum", "university", "science", "history", "garden", "recipes", "travel", "music", "theatre", "school", "hospital",
    "health", "law", "finance", "sports", "football", "cinema", "photography", "software", "docs", "wiki", "forum", "city", "council", "parliament",
    "nature", "mathematics", "physics", "chemistry", "language", "dictionary", "literature", "poetry", "art", "design", "maps", "education",
    "translation", "nutrition", "transport", "railway", "airport", "bakery", "village", "island", "river", "forest", "astronomy", "biology",
    "geology", "archive", "letters", "cycling", "hiking", "sailing", "chess", "opera", "painting", "pottery", "weaving", "knitting", "woodwork",
)
WITH = ("", "-online", "-club", "-daily", "-best", "-24", "my-", "the-", "top-", "euro")
ENDINGS = ("com", "net", "org", "info", "co.uk")
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/12", "/de/340.html", "/fr/77/", "/es/9", "/en/4031", "/about", "/2020/05/item")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, label; 1 = block): every theme with every addition; prefixes, endings and paths in turn."""
    rows = []
    for label, themes in ((1.0, UNWANTED), (0.0, WANTED)):
        for i, theme in enumerate(themes):
            for j, own in enumerate(WITH):
                name = f"{theme}{own}" if own.startswith("-") or not own else f"{own}{theme}"
                for k in range(2):
                    n = 3 * i + 5 * j + 7 * k
                    rows.append((f"http://{PREFIXES[n % len(PREFIXES)]}{name}.{ENDINGS[n % len(ENDINGS)]}{PATHS[n % len(PATHS)]}", label))
    return spark.createDataFrame(rows, "url string, label double")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i)
    return df.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def rule_columns(rules: tuple[Rule, ...] | list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equal lengths the smaller text."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        which = F.when(fits(rule), F.lit(rule.text)).otherwise(which)
        verdict = F.when(fits(rule), F.lit(rule.verdict)).otherwise(verdict)
    return which, verdict


def _grams(name: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of a column between end marks, each with the column's name."""
    marked = F.concat(F.lit("^"), F.col(name), F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{name[0]}:"), F.substring(marked, i, F.lit(n))))

    return F.concat(*[of_size(n) for n in sizes])


def with_grams(df: DataFrame, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    return df.withColumn("grams", F.concat(_grams("host", sizes), _grams("path", sizes)))


def fit(labelled: DataFrame, features: int = 1 << 16, sizes: tuple[int, ...] = (3, 4), reg: float = 0.002, iterations: int = 60) -> PipelineModel:
    """Logistic regression from (url, label) rows; the table is small by contract of the operator."""
    data = with_grams(with_parts(labelled), sizes).select("grams", "label").coalesce(1)
    hashing = HashingTF(numFeatures=features, inputCol="grams", outputCol="features", binary=True)
    regression = LogisticRegression(maxIter=iterations, regParam=reg, featuresCol="features", labelCol="label", predictionCol="blocked")
    return Pipeline(stages=[hashing, regression]).fit(data)


def judge(pages: DataFrame, model: PipelineModel, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url_col: str = "url", sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """(key, host, path, rule, verdict, score): the rule's verdict, else the model's; score is the model's."""
    from pyspark.ml.functions import vector_to_array

    parts = with_grams(with_parts(pages.select(F.col(key).alias("_key"), F.col(url_col).alias("url"))), sizes)
    scored = model.transform(parts)
    which, verdict = rule_columns(rules)
    learned = F.when(F.col("blocked") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("_key").alias(key), "host", "path", which.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
        vector_to_array("probability")[1].alias("score"),
    )
