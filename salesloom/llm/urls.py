"""Operator 9: URL filter, rules by host and path first, logistic regression for the rest.

The model reads hashed character n-grams of host and path and is trained on a
small labelled URL table (a bounded input by nature: its size does not follow
the data that is judged). Fitting and scoring are Spark ML on the JVM.

Defined results: a URL that is null or has no `://` has an empty host and path,
fits no rule and is judged on no n-grams, that is by the model's intercept; an
empty table gives an empty table; repeated rows are judged each; extra columns
of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm.columns import ascii_lower, packed, unpacked

GRAMS = (3, 4)
BUCKETS = 1 << 14
BLOCK_FROM = 0.6  # probability from which the model blocks; below it a URL has the benefit of the doubt


@dataclass(frozen=True)
class UrlRule:
    """A rule for a host, its subdomains, and the paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

# Words of unwanted sites and of ordinary ones, for the labelled table.
BLOCKED_WORDS = """cheap pills spam farm casino bonus free prizes adult videos followers payday loans lottery winner
singles replica watches crypto doubler poker betting crack keygen cams
ads track tracker click popunder malware phishing scam xxx""".split()
ALLOWED_WORDS = """news library university physics blog garden docs museum weather recipes council forum journal travel
health radio theatre science history music school river theory reading article
nation station nature thing thinking other mother northern lesson""".split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no `://`."""
    begun = F.coalesce(url, F.lit("")).contains("://")
    after = F.when(begun, F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)).otherwise("")
    host = ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, label), 1 is blocked: four URLs from each word and its neighbours."""
    rows = []
    for label, words in ((1.0, BLOCKED_WORDS), (0.0, ALLOWED_WORDS)):
        for k, w in enumerate(words):
            u, v = words[(k + 1) % len(words)], words[(k + 7) % len(words)]
            made = (f"http://{w}-{u}.test/en/{k}", f"https://www.{w}{v}.test/{u}/{k}.html", f"http://m.{v}.test/{w}", f"https://{w}.test/fr/{k}#top")
            rows += [F.struct(F.lit(x).alias("url"), F.lit(label).alias("label")) for x in made]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host, marked h, and of the path, marked p."""
    return F.concat(*[_grams_of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in GRAMS])


def _grams_of(mark: str, text: Column, n: int) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n))))


def train(labelled: DataFrame, strength: float = 0.01) -> PipelineModel:
    """Logistic regression on hashed n-grams of (url, label)."""
    parts = labelled.select("label", *[c.alias(n) for c, n in zip(url_parts(F.col("url")), ("host", "path"))])
    features = parts.select("label", _grams(F.col("host"), F.col("path")).alias("grams"))
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True),
        LogisticRegression(regParam=strength, maxIter=100, tol=1e-9),
    ]
    return Pipeline(stages=stages).fit(features)


def _fitting_rule(rules: tuple[UrlRule, ...], host: Column, path: Column) -> Column:
    """The longest rule (host and path together) that fits, as (rule, verdict), or null."""
    fits = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        at_host = (host == r.host) | host.endswith("." + r.host)
        fits.append(F.when(at_host & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def url_filter(
    pages: DataFrame,
    model: PipelineModel,
    rules: tuple[UrlRule, ...] = RULES,
    block_from: float = BLOCK_FROM,
    url: str = "url",
    out: str = "url_filter",
) -> DataFrame:
    """The pages with a struct column `out`: host, path, rule, verdict and the model's probability of a block."""
    rows = packed(pages, url=url)
    host, path = url_parts(F.col("url"))
    rows = rows.select("row", host.alias("host"), path.alias("path"))
    named = (F.col("host") != "") | (F.col("path") != "")
    rows = rows.withColumn("grams", F.when(named, _grams(F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    scored = model.transform(rows).withColumn("found", _fitting_rule(rules, F.col("host"), F.col("path")))
    probability = F.get(vector_to_array("probability"), F.lit(1))
    by_model = F.when(probability >= block_from, "block").otherwise("allow")
    judged = F.struct(
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_model).alias("verdict"),
        probability.alias("block_probability"),
    )
    return unpacked(scored.select("row", judged.alias("judged")), pages.columns, **{out: "judged"})
