"""URL filters: rules first, then gradient-boosted trees on lexical features (DataFrame functions and MLlib only).

Rules name a host and a path; a rule fits its host and all subdomains of it if
the path starts with the rule's, and the longest rule that fits decides.  The
URLs that rules decide are the labelled ones.  Boosted trees learn from a
sample of them (about ``sample_rows``, a documented bound, by the hash of id
and URL, so that pages of one URL are drawn each on their own; only rows that
repeat both go together) and judge the rest by length, depth, digit ratio,
character entropy, parameter counts and statistics of the host's suffixes.  Suffix statistics are
counted over all pages, one row per suffix, and joined back; the planner
broadcasts that table only if its written size is under its threshold.

Defined results: a null URL, or one without ``://``, has empty host and path
and is judged by the trees like any other; where the rules decide no URL the
verdict is ``allow``, and where they only ever decide one way it is that; rows
that share an id are judged each on their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, staged

#: Fixed values: (rule, verdict) of the registered query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
HOST_PATH = r"://([^/?#]*)([^?#]*)"
LEXICAL = ("f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_params", "f_query_len",
           "f_fragment", "f_entropy", "f_host_entropy")
SUFFIX = ("f_pages1", "f_blocked1", "f_pages2", "f_blocked2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, HOST_PATH, 1)), F.regexp_extract(url, HOST_PATH, 2)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):  # later ones are longer and go first
        fits = rule_fits(name, host, path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def entropy(c: Column) -> Column:
    """Bits per character."""
    n = F.char_length(c)
    share = F.transform(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")),
                        lambda x: (n - F.char_length(F.replace(c, x, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(url: str, host: str, path: str) -> dict[str, Column]:
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda c, x: F.regexp_count(c, F.lit(x))
    return {k: v.cast("double") for k, v in zip(LEXICAL, (
        F.char_length(u), F.char_length(h), F.char_length(p), count(p, "/"), count(h, r"\."),
        count(u, "[0-9]") / F.greatest(F.char_length(u), F.lit(1)), count(h, "-"),
        F.when(query == "", 0).otherwise(count(query, "&") + 1), F.char_length(query), u.contains("#").cast("int"),
        entropy(u), entropy(h)))}


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def with_suffix_statistics(x: DataFrame) -> DataFrame:
    """Adds, for the last one and two labels of the host, the logarithm of their
    pages and the smoothed share of blocked ones among those that rules decide.

    A row's own verdict is left out of its share: trees that saw it would learn
    to read the answer off the feature."""
    block = (F.col("rule_verdict") == "block").cast("int")
    own = F.col("rule_verdict").isNotNull().cast("int")
    for k in (1, 2):
        x = x.withColumn("suffix", suffix(F.col("host"), k))
        table = x.groupBy("suffix").agg(F.count("*").alias("pages"), F.count("rule_verdict").alias("known"),
                                        F.sum(block).alias("blocked"))
        table = staged(table.select(F.col("suffix").alias("of"), F.log1p("pages").alias(f"f_pages{k}"), "known",
                                    F.coalesce("blocked", F.lit(0)).alias("blocked")), f"suffix{k}")
        x = x.join(table, x["suffix"] == table["of"]).withColumn(
            f"f_blocked{k}", (F.col("blocked") - F.coalesce(block, F.lit(0)) + 1.0) / (F.col("known") - own + 2.0))
        x = x.drop("suffix", "of", "known", "blocked")
    return x


def draw(seed: int) -> Column:
    """A number under a million for a row (page_id, url), the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce("url", F.lit("")), "page_id"), F.lit(1_000_000))


def in_sample(share: float, seed: int) -> Column:
    """Whether a row (page_id, url) is drawn, by the hash of both."""
    return draw(seed) < int(share * 1_000_000)


def labelled_sample(known: DataFrame, counts: dict[str, int], sample_rows: int, least: int, seed: int) -> DataFrame:
    """About ``sample_rows`` of the rows that rules decide, the same share of each
    verdict, but about ``least`` rows of one that is rarer (all, if it has fewer).

    Copies of one page are drawn together; a verdict of which none is drawn gives
    its ``least`` first rows instead, so the sample stays bounded and two-sided.
    """
    share = sample_rows / sum(counts.values())
    of = {v: known.filter(F.col("rule_verdict") == v) for v in sorted(counts)}
    drawn = [x.filter(in_sample(min(1.0, max(share, least / counts[v])), seed)) for v, x in of.items()]
    drawn = staged(reduce(DataFrame.unionByName, drawn).coalesce(4), "sample")
    found = {r["rule_verdict"] for r in drawn.select("rule_verdict").distinct().collect()}
    first = [x.orderBy(draw(seed), "page_id", "url").limit(least) for v, x in of.items() if v not in found]
    return reduce(DataFrame.unionByName, first, drawn)


def judge_urls(pages: DataFrame, rules=RULES, sample_rows: int = 20_000, trees: int = 20, depth: int = 4,
               seed: int = 7, least: int = 1000) -> DataFrame:
    """Each row of ``pages`` (page_id, url) with ``host``, ``path``, ``rule``, ``verdict``,
    ``score`` (the trees' probability of block; null where a rule decides) and
    ``by_trees`` (what the trees say of any row; null if there are none)."""
    host, path = host_and_path(F.col("url"))
    x = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    x = x.withColumns({"rule": rule, "rule_verdict": verdict}).withColumns(lexical("url", "host", "path"))
    x = staged(with_suffix_statistics(x), "urls")
    known = x.filter(F.col("rule_verdict").isNotNull())
    counts = {r["rule_verdict"]: r["n"] for r in known.groupBy("rule_verdict").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        only = next(iter(counts), "allow")
        return x.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(only)).alias("verdict"),
                        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("by_trees"))
    assemble = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features")
    sample = labelled_sample(known, counts, sample_rows, least, seed)
    sample = assemble.transform(sample.withColumn("label", (F.col("rule_verdict") == "block").cast("double")))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed,
                          cacheNodeIds=False, minInstancesPerNode=2).fit(sample.select("features", "label"))
    names = fresh(x, "rawPrediction", "probability", "prediction")
    model = model.setRawPredictionCol(names[0]).setProbabilityCol(names[1]).setPredictionCol(names[2])
    out = model.transform(assemble.transform(x))
    from pyspark.ml.functions import vector_to_array

    score = F.when(F.col("rule_verdict").isNull(), F.get(vector_to_array(F.col(names[1])), F.lit(1)))
    by_trees = F.when(F.col(names[2]) == 1.0, "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", by_trees).alias("verdict"),
                      score.alias("score"), by_trees.alias("by_trees"))


def op8_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
