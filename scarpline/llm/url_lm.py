"""URL filter: rules first, else a character language-model ratio (DataFrame functions only).

Two variable-order Markov models over characters, one learned from URLs that
the rules accept and one from URLs that they reject. The longest context (two
characters, one, none) that was seen ``min_context`` times gives the estimate;
each order is smoothed by the next shorter one. A URL is accepted when its
log-likelihood difference per character reaches a threshold calibrated on the
rule-judged URLs: the middle of both class means.

Characters are folded to ``SYMBOLS`` classes, so the ratio table has exactly
``SYMBOLS ** 3`` entries whatever the number of URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scarpline.llm import common

PLAIN = "abcdefghijklmnopqrstuvwxyz/.-_?=&%#:~+@"  # digits share one further symbol, the rest another
SYMBOLS = len(PLAIN) + 2
START = SYMBOLS - 1  # the class of other characters also stands before the text


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """``name`` or ``verdict`` of the longest fitting rule, else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def _symbols(url: Column) -> Column:
    """The lower-cased URL behind its scheme as an array of symbol numbers."""
    text = common.ascii_lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))

    def number(c: Column) -> Column:
        at = F.call_function("instr", F.lit(PLAIN), c)
        digit = c.between("0", "9")
        return F.when(digit, len(PLAIN)).when(at > 0, at - 1).otherwise(START)

    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), number)


def _grams(url: Column) -> Column:
    """Each character with its two predecessors, as one number."""
    padded = F.concat(F.array(F.lit(START), F.lit(START)), _symbols(url))
    tail = lambda k: F.slice(padded, k + 1, F.greatest(F.size(padded) - 2, F.lit(0)))
    pairs = F.zip_with(tail(0), tail(1), lambda a, b: a * SYMBOLS + b)
    return F.zip_with(pairs, tail(2), lambda ab, c: ab * SYMBOLS + c)


def ratio_table(judged: DataFrame, min_context: int = 8, prior: float = 4.0) -> DataFrame:
    """One row: the log ratio of accepted to rejected for every symbol triple.

    ``judged`` has ``verdict`` and ``grams``. Counts are partial aggregates
    of at most 2 x SYMBOLS^3 rows.
    """
    spark = judged.sparkSession
    seen = judged.select("verdict", F.explode("grams").alias("g")).groupBy("g").agg(
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")]
    )
    cells = spark.range(SYMBOLS**3).withColumnRenamed("id", "g").join(seen, "g", "left").fillna(0)
    cells = cells.withColumn("c", F.col("g") % SYMBOLS)
    cells = cells.withColumn("b", F.floor(F.col("g") / SYMBOLS) % SYMBOLS).withColumn("a", F.floor(F.col("g") / SYMBOLS**2))

    def totals(keys: list[str], suffix: str) -> DataFrame:
        sums = [F.sum(v).alias(v + suffix) for v in ("allow", "block")]
        return cells.groupBy(*keys).agg(*sums) if keys else cells.agg(*sums)

    joined = (
        cells.join(totals(["b", "c"], "_bc"), ["b", "c"]).join(totals(["c"], "_c"), "c")
        .join(totals(["a", "b"], "_ab_"), ["a", "b"]).join(totals(["b"], "_b_"), "b").crossJoin(totals([], "_all"))
    )

    def log_p(v: str) -> Column:
        p = (F.col(v + "_c") + prior / SYMBOLS) / (F.col(v + "_all") + prior)
        for joint, context in ((v + "_bc", v + "_b_"), (v, v + "_ab_")):
            kept = F.col(context) >= min_context
            p = F.when(kept, (F.col(joint) + F.lit(prior) * p) / (F.col(context) + prior)).otherwise(p)
        return F.log(p)

    # order-0 to order-2 estimates are cheap per cell; the table is a constant size
    rows = joined.select("g", (log_p("allow") - log_p("block")).alias("r"))
    ordered = F.array_sort(F.collect_list(F.struct("g", "r")))
    return rows.agg(F.transform(ordered, lambda x: x["r"]).alias("ratios"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Host, path, rule, verdict and score of every URL.

    NULL, empty and scheme-less URLs have empty host and path and the neutral
    score 0. Without judged URLs of one class every ratio stays near 0 and the
    threshold is 0. Repeated rows repeat. Other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", longest_rule(host, path, rules, "name"))
    rows = rows.withColumn("_by_rule", longest_rule(host, path, rules, "verdict")).withColumn("grams", _grams(F.col("_url")))
    judged = rows.filter(F.col("_by_rule").isNotNull()).select(F.col("_by_rule").alias("verdict"), "grams")
    ratios = ratio_table(judged).scalar()
    rows = rows.withColumn("_ratios", ratios)
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.element_at("_ratios", (g + 1).cast("int")))
    scored = rows.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))
    mean = lambda v: F.avg(F.when(F.col("_by_rule") == v, F.col("score")))
    middle = scored.filter(F.col("_by_rule").isNotNull()).agg(((mean("allow") + mean("block")) / 2).alias("t"))
    threshold = middle.select(F.coalesce("t", F.lit(0.0))).scalar()
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_model).alias("verdict"), "score")
