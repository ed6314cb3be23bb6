"""URL filtering by fixed host and path rules, and by association rules that FP-growth mines from labelled URLs
(DataFrame expressions and Spark's FPGrowth only).

A URL is a set of tokens: labels of its host, segments of its path (digits as #), names of its parameters. Token
combinations of any length that go with the label `block` often enough (support) and surely enough (confidence) become
rules; a rule is dropped if a part of its tokens is as sure. An inverted index holds each rule under its rarest token; a
URL meets the rules of its own tokens and keeps those of which it has all tokens.

Defined cases: a null URL, or one without `://`, has an empty host and path and no tokens, so it is allowed; repeated
rows and null identifiers are judged like any other; without labels no rule is mined; an empty table gives an empty
result; a very long URL keeps all its tokens; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.scratch import stored

BLOCK = "=block"
#: (verdict, host, path) of the contract's rules. Fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Which pages are labelled `block`: those whose number has a label that is toxic or of low quality.
MIN_SUPPORT, MIN_CONFIDENCE = 0.004, 0.4


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    parts = lambda c, sep, mark: F.transform(F.filter(F.split(c, sep), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    names = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    shape = F.regexp_replace(path, "[0-9]+", "#")
    return F.array_distinct(F.concat(parts(host, r"\.", "h:"), parts(shape, "/", "p:"), F.transform(names, lambda x: F.concat(F.lit("q:"), x))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled (tokens, blocked boolean). Rules (tokens, confidence, first: the rarest token) for blocking."""
    spark = labelled.sparkSession
    baskets = stored(labelled.select(F.when(F.col("blocked"), F.array_append("tokens", BLOCK)).otherwise(F.col("tokens")).alias("items")), "baskets")
    if not baskets.limit(1).count():
        return spark.createDataFrame([], "tokens array<string>, confidence double, first string")
    frequent = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets
    frequent = stored(frequent.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    both = frequent.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("tokens"), F.col("freq").alias("both"))
    rules = both.join(frequent.withColumnRenamed("items", "tokens"), "tokens").select("tokens", (F.col("both") / F.col("freq")).alias("confidence"))
    rules = stored(rules.filter(F.col("confidence") >= min_confidence), "rules")
    # A rule falls if another with fewer tokens, all of them its own, is as sure.
    less = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"), F.col("tokens")[0].alias("token"))
    wider = rules.withColumn("token", F.explode("tokens"))
    beaten = wider.join(less, "token").filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens")
    rules = rules.join(beaten, "tokens", "left_anti")
    single = frequent.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.withColumn("token", F.explode("tokens")).join(single, "token").groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("first"))
    return stored(rarest, "index")


def mined_score(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens), distinct. url and score: the confidence of the surest rule that it meets."""
    posting = urls.select("url", F.col("tokens").alias("own"), F.explode("tokens").alias("first"))
    met = posting.join(rules, "first").filter(F.size(F.array_except("tokens", "own")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("score"))


def judge(pages: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """pages (page_id, url), labels (page_id, blocked). page_id, host, path, rule, verdict, score."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    with_tokens = pages.select("page_id", "url", tokens_of(F.col("url"), host, path).alias("tokens"))
    rules = mine_rules(with_tokens.join(labels.select("page_id", "blocked"), "page_id").select("tokens", "blocked"), **how)
    score = mined_score(with_tokens.select("url", "tokens").filter("url is not null").distinct(), rules).withColumnRenamed("url", "_url")
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(score, F.col("url") == F.col("_url"), "left")
    fixed = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumn("_fixed", fixed)
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("score").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), "score")


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    labels = labels.withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labels)


OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '\?([^#]*)', 1) AS q FROM pages),
t AS (
  SELECT DISTINCT page_id, url, unnest(list_concat(list_concat(
    [concat('h:', x) FOR x IN string_split(host, '.') IF x <> ''],
    [concat('p:', x) FOR x IN string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') IF x <> '']),
    [concat('q:', x) FOR x IN regexp_extract_all(q, '(?:^|&)([^=&]+)', 1)])) AS token FROM p),
l AS (SELECT doc_id AS page_id, coalesce(max(toxic = 1 OR quality = 0), false) AS blocked FROM labels GROUP BY 1),
least_n AS (SELECT ceil({MIN_SUPPORT} * count(*)) AS m FROM p JOIN l USING (page_id)),
-- Only tokens that are blocked often enough by themselves can be part of a rule; all their combinations are made.
often AS (SELECT token FROM t JOIN l USING (page_id), least_n WHERE blocked GROUP BY token, m HAVING count(*) >= m),
own AS (SELECT page_id, any_value(url) AS url, list(token ORDER BY token) AS a FROM t JOIN often USING (token) GROUP BY 1),
sets AS (SELECT page_id, url, [a[i + 1] FOR i IN range(len(a)) IF (bits >> i) & 1 = 1] AS items FROM (SELECT *, unnest(range(1, CAST(1 AS BIGINT) << len(a))) AS bits FROM own)),
rules AS (
  SELECT items, hit / freq AS confidence FROM (SELECT items, count(*) AS freq, count(*) FILTER (WHERE blocked) AS hit FROM sets JOIN l USING (page_id) GROUP BY 1), least_n
  WHERE hit >= m AND hit > 0 AND hit / freq >= {MIN_CONFIDENCE}),
score AS (SELECT url, max(confidence) AS score FROM sets JOIN rules USING (items) GROUP BY 1),
f AS (SELECT page_id, host, path, score, CASE
  WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p LEFT JOIN score USING (url))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN score IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, score FROM f
"""
