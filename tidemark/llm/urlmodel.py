"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

Everything is Spark columns and aggregates. The model learns from a small labelled URL table; training keeps a vector of fixed
size on the driver and sends it to the next pass as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage

SLOTS = 4096
SIZES = (3, 4, 5)
#: Bound of the labelled table: those rows with the smallest hash of the url.
MAX_LABELLED = 2_000
ROUNDS = 30


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or without '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; '' for null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: (rule, verdict): host and path prefix. The longest rule that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (null if none) and its verdict. A rule fits its host and all subdomains if the path starts with its own."""
    which, verdict = None, None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        which = F.when(fits, rule) if which is None else which.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return which, verdict


def _grams(kind: str, text: Column, n: int) -> Column:
    def slot(i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), text.substr(i, F.lit(n))), F.lit(SLOTS - 1)) + 1

    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, slot)


def slots(host: Column, path: Column) -> Column:
    """Hash slots of the distinct character n-grams of '^host$' and '^path', sorted; slot 0 (bias) is always there."""
    texts = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path)))
    grams = [_grams(kind, text, n) for kind, text in texts for n in SIZES]
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), *grams)))


def literal(values: list[float]) -> Column:
    """A constant array column: folded once, not evaluated per row."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def score(at: Column, weights: list[float]) -> Column:
    """Probability of 'block' from the slots of a url; each n-gram weighs 1/sqrt(number of n-grams)."""
    w = literal(weights)
    total = F.aggregate(F.transform(at, lambda i: F.element_at(w, (i + 1).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-total / F.sqrt(F.size(at).cast("double"))))


def labelled_urls(pages: DataFrame, rules=RULES, most: int = MAX_LABELLED) -> DataFrame:
    """A small labelled URL table: distinct (host, path) that a rule judges, at most ``most``, those of smallest hash.

    label 1: block. Rows: host, path, label.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), path.alias("path")).withColumn("says", ruling(F.col("host"), F.col("path"), rules)[1])
    few = judged.where("says IS NOT NULL").distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)
    return few.select("host", "path", (F.col("says") == "block").cast("int").alias("label"))


def fit(labelled: DataFrame, rounds: int = ROUNDS, rate: float = 2.0, decay: float = 1e-3) -> list[float]:
    """Weights by full-batch gradient descent with per-slot step sizes, from (host, path, label).

    Null hosts and paths count as ''; rows with a label other than 0 and 1 are not learned from. Both classes weigh the same in
    total. Without rows all weights are 0.
    """
    text = [F.coalesce(c, F.lit("")) for c in ("host", "path")]
    rows = labelled.where("label IN (0, 1)").select(slots(*text).alias("at"), "label")
    rows = cut_lineage(rows)
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    share = {k: 0.5 / v for k, v in n.items()}
    weights, squares = [0.0] * SLOTS, [1e-8] * SLOTS
    for _ in range(rounds if n else 0):
        error = (score(F.col("at"), weights) - F.col("label")) * F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
        per_gram = error / F.sqrt(F.size("at").cast("double"))
        sums = rows.select(per_gram.alias("g"), F.explode("at").alias("slot")).groupBy("slot").agg(F.sum("g").alias("g")).collect()
        for r in sums:
            g = r.g + decay * weights[r.slot] / SLOTS
            squares[r.slot] += g * g
            weights[r.slot] -= rate * g / math.sqrt(squares[r.slot])
    return [round(w, 9) for w in weights]


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the model's, for every url), one row per row of ``pages`` (page_id, url).

    Where no rule fits, the verdict is 'block' if p_block is at least 0.5. Null urls have empty host and path and are judged too.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    which, says = ruling(F.col("host"), F.col("path"), rules)
    p = score(slots(F.col("host"), F.col("path")), weights)
    scored = named.select("*", which.alias("rule"), says.alias("__says"), p.alias("p_block"))
    verdict = F.coalesce("__says", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
