"""URL filter: rules first, then a ratio of character language models (DataFrame functions only).

Rules are (verdict, host, path). A rule fits its host and all subdomains when
the url's path starts with the rule's; the longest fitting rule decides.

All other urls are judged by two smoothed variable-order Markov models over the
characters of host and path, one trained on the urls that rules accept, one on
those they block. Characters fold to ``ALPHABET`` (any digit: 0, anything else:
~), orders 2, 1 and 0 are interpolated by Witten-Bell weights (a context counts
as much as its number of occurrences against its number of followers), so the
models are tables of ``len(ALPHABET)**3`` rows, whatever the corpus: that bounds
what is broadcast. The url's score is the mean log-likelihood difference per
character; the limit is the one of greatest balanced accuracy on the ruled urls,
found in a histogram of ``BINS`` bins.

Counts and scores are added up before each shuffle. Defined cases: null or no
``://``: empty host and path, no rule, score of the empty string; without
accepted or without blocked urls the models know nothing and allow; repeated
rows are judged alike; urls of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrid.llm.common import stash

# The rules of the query, (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGE = "^"
ALPHABET = EDGE + LOWER + "0./-_~"
BINS, REACH = 4_000, 10.0  # bins of the calibration histogram over scores from -REACH to REACH


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def folded(host: Column, path: Column) -> Column:
    """The characters a model sees."""
    text = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "000000000")
    return F.regexp_replace(text, r"[^a-z0./_\-]", "~")


def grams(text: Column) -> Column:
    """All windows of three characters, one for each character and one for the end."""
    padded = F.concat(F.lit(EDGE * 2), text, F.lit(EDGE))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: padded.substr(i, F.lit(3)))


def log_likelihoods(counted: DataFrame, n: str) -> DataFrame:
    """(gram, lp): interpolated log probability of each gram's last character, from counts ``n``."""
    grid = counted.select("gram", F.col("gram").substr(1, 2).alias("two"), F.col("gram").substr(2, 1).alias("one"),
                          F.col("gram").substr(3, 1).alias("c"), F.col(n).alias("n"))
    zero = grid.groupBy("c").agg(F.sum("n").alias("n"))
    total = F.lit(1.0 / len(ALPHABET))
    sums = zero.agg(F.sum("n").alias("all"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()  # one row
    zero = zero.select("c", ((F.col("n") + sums.kinds * total) / F.lit(float(max(sums["all"] + sums.kinds, 1)))
                             + (F.lit(0.0) if sums["all"] else total)).alias("p0"))

    def blend(level: DataFrame, context: str, lower: DataFrame, on: list[str], below: str, name: str) -> DataFrame:
        """P = (n + T * P_lower) / (N + T), with T the number of kinds that follow the context."""
        ctx = level.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("t"))
        t = F.greatest(F.col("t"), F.lit(1))
        return (level.join(F.broadcast(ctx), context).join(F.broadcast(lower), on)
                .withColumn(name, (F.col("n") + t * F.col(below)) / (F.col("total") + t)))

    one = blend(grid.groupBy("one", "c").agg(F.sum("n").alias("n")), "one", zero, ["c"], "p0", "p1").select("one", "c", "p1")
    two = blend(grid, "two", one, ["one", "c"], "p1", "p2")
    return two.select("gram", F.log("p2").alias("lp"))


def train(pages: DataFrame) -> DataFrame:
    """(gram, ratio) for every possible gram, from ``pages`` (text, verdict of a rule)."""
    spark = pages.sparkSession
    k = len(ALPHABET)
    letter = lambda i: F.substring(F.lit(ALPHABET), (i + 1).cast("int"), F.lit(1))
    i = F.col("id")
    grid = spark.range(k ** 3).select(
        F.concat(letter(F.floor(i / (k * k))), letter(F.floor(i / k) % k), letter(i % k)).alias("gram"))
    counts = (pages.where("verdict is not null").select("verdict", F.explode(grams(F.col("text"))).alias("gram"))
              .groupBy("gram").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"),
                                   F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")))
    counted = stash(grid.join(counts, "gram", "left").na.fill(0), "grams")
    good, bad = log_likelihoods(counted, "allowed"), log_likelihoods(counted, "blocked")
    return stash(good.join(bad.withColumnRenamed("lp", "lq"), "gram").select("gram", (F.col("lp") - F.col("lq")).alias("ratio"))
                 .coalesce(1), "ratio")


def scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, score) of the distinct texts; the model has ``len(ALPHABET)**3`` rows and is broadcast."""
    return (texts.select("text").distinct().select("text", F.explode(grams(F.col("text"))).alias("gram"))
            .join(F.broadcast(model), "gram").groupBy("text").agg(F.avg("ratio").alias("score")))


def calibrate(ruled: DataFrame, model: DataFrame) -> float:
    """The score of greatest balanced accuracy on ruled urls (text, verdict)."""
    seen = ruled.groupBy("text", "verdict").agg(F.count("*").alias("n"))
    step = 2 * REACH / BINS
    place = F.floor((F.greatest(F.least(F.col("score"), F.lit(REACH)), F.lit(-REACH)) + REACH) / step)
    bins = (seen.join(scores(seen, model), "text").groupBy(place.alias("bin"))
            .agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("bad"))
            .orderBy("bin").collect())  # BINS + 1 rows at most
    good, bad = sum(b.good for b in bins), sum(b.bad for b in bins)
    if not good or not bad:
        return float("-inf")
    best, limit, good_below, bad_below = -1.0, 0.0, 0, 0
    for b in bins:
        value = (good - good_below) / good + bad_below / bad
        if value > best:
            best, limit = value, b.bin * step - REACH
        good_below, bad_below = good_below + b.good, bad_below + b.bad
    return limit


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per input row; score is null where a rule decides."""
    host, path = host_and_path(F.col("url"))
    rows = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"),
                    folded(F.col("host"), F.col("path")).alias("text")))
    rows = stash(rows, "urls")
    ruled = rows.where("rule is not null").select("text", "verdict")
    known = {r.verdict for r in ruled.select("verdict").distinct().collect()}  # at most two
    if known != {"allow", "block"}:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("score"))
    model = train(rows)
    limit = calibrate(ruled, model)
    judged = scores(rows.where("rule is null"), model)
    return (rows.join(judged.withColumnRenamed("text", "judged"), F.col("rule").isNull() & (F.col("text") == F.col("judged")), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
                    "score"))
