"""URL judgements: rules by host suffix and path prefix, else a model of character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import UPPER, load

#: (verdict, rule); a rule is a host and a path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SIZES = (3, 4)
FEATURES = 1 << 14
#: Scores above it block: about the share of unwanted addresses in the table.
THRESHOLD = 0.2

#: Words of ordinary and of unwanted hosts.
ORDINARY = (
    "news library museum school science history weather garden music travel kitchen river mountain "
    "forum journal research market health sport theatre cinema photo archive village bakery "
    "university hospital council railway harbour teacher student cooking hiking bicycle football "
    "poetry painting physics biology chemistry language dictionary encyclopedia map city bridge "
    "castle forest ocean island winter summer family children house"
).split()
UNWANTED = (
    "casino poker betting bets gambling jackpot viagra pills pharma cheap xxx adult porn cams "
    "escort spam farm ads tracker track win free loans warez crack"
).split()


def labelled_addresses() -> list[tuple[str, int]]:
    """A small table of addresses, 1 is unwanted; about three ordinary ones to one unwanted.

    Hosts are words, pairs of words and, for ordinary ones, names of plain syllables, so that what
    the model hasn't seen counts for nothing. Prefixes, endings, languages and paths are dealt out
    alike on both sides and tell nothing.
    """
    syllables = [c + v for c in "bdfghklmnprst" for v in "aeiou"] + "th er on in an st re ti nd le".split()
    n = len(syllables)
    names = [
        "".join(syllables[(i * k + k * k) % n] for k in range(1, 3 + i % 3)) for i in range(1, 600)
    ]
    n = len(ORDINARY)
    good = [*ORDINARY, *[f"{a}-{ORDINARY[(7 * i + 3) % n]}" for i, a in enumerate(ORDINARY)], *names]
    n = len(UNWANTED)
    bad = [*UNWANTED, *[f"{a}-{UNWANTED[(i + k) % n]}" for k in (1, 2, 5, 8) for i, a in enumerate(UNWANTED)]]
    bad += [f"{a}{UNWANTED[(i + 3) % n]}" for i, a in enumerate(UNWANTED)]
    bad += [f"{ORDINARY[(5 * i) % len(ORDINARY)]}-{a}" for i, a in enumerate(UNWANTED)]
    rows = []
    for label, hosts in ((0, good), (1, bad)):
        for i, host in enumerate(hosts):
            lead = ("", "www.", "m.", "blog.")[i % 4]
            site = (".example", "", "")[i % 3]
            end = ("com", "org", "net")[(i // 2) % 3]
            lang = ("en", "de", "fr", "es")[(i // 3) % 4]
            number = 17 * i * i % 9973
            tail = (f"/{lang}/{number}", f"/{lang}/{number}.html", f"/{lang}/{number}/", "/",
                    "/article/about", f"/{lang}/guide/index.html", "")[(i // 5) % 7]
            rows.append((f"https://{lead}{host}{site}.{end}{tail}", label))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end. The first ``://`` counts, none in the query."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*)", 1), F.lit(""))


def _grams(text: Column) -> Column:
    """Character n-grams of all SIZES; a text shorter than a size has none of it."""
    return F.concat(
        *[
            F.when(
                F.length(text) >= n,
                F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))),
            ).otherwise(F.array().cast("array<string>"))
            for n in SIZES
        ]
    )


def _features(df: DataFrame) -> DataFrame:
    grams = F.concat(
        F.transform(_grams(F.concat(F.lit("."), "host", F.lit("."))), lambda g: F.concat(F.lit("h"), g)),
        F.transform(_grams(F.col("path")), lambda g: F.concat(F.lit("p"), g)),
    )
    tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__features")
    return tf.transform(df.withColumn("__grams", grams))


def train(labelled: DataFrame, strength: float = 0.01):
    """Fit logistic regression to a small table (url, label); rows with nulls teach nothing."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("label").cast("double").alias("__label"),
    )
    return LogisticRegression(
        featuresCol="__features", labelCol="__label", probabilityCol="__probability",
        predictionCol="__prediction", rawPredictionCol="__raw", regParam=strength, maxIter=50,
    ).fit(_features(rows))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The verdict and rule of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's path. ``rules`` is
    a short list; of equally long ones the first counts.
    """
    picked = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = (
            ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        )
        picked = F.when(
            fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        ).otherwise(picked)
    return picked


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, score.

    Null urls and urls without ``://`` have empty host and path; no rule fits them and the model
    judges the empty address. An empty table gives none. ``score`` is the model's probability that the address is unwanted;
    above ``THRESHOLD`` it blocks. Other columns are ignored, repeated rows are judged alike.
    """
    model = train(labelled)
    parts = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    scored = model.transform(_features(parts))
    score = F.element_at(vector_to_array("__probability"), 2)
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    return scored.select(
        "page_id",
        "host",
        "path",
        rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(score > THRESHOLD, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_addresses(), "url string, label int")
    return judge(load(spark, sf_dir, "pages", "page_id", "url"), labelled)
