"""Verdicts on URLs: rules by host and path, and boosted trees on lexical features.

URLs that a rule fits are the labelled ones.  Gradient-boosted trees learn from them what
blocked URLs look like and judge the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import Scratch, lookup_table

ALLOW, BLOCK = "allow", "block"

# The rules of the contract.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)

SAMPLE = 20_000
"""About so many distinct labelled URLs are learned from."""
FOLDS = 4
TREES, DEPTH = 20, 4
PRIOR = 10.0
"""Weight of the overall share of blocked URLs in the share of a suffix."""
FEATURES = (
    "length", "host_length", "path_length", "labels", "depth", "digits", "marks", "capitals",
    "parameters", "query_length", "entropy", "suffix_share", "domain_share",
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    same = (F.col("host") == host) | F.col("host").endswith("." + host)
    return same & F.col("path").startswith(slash + path)


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rule``: the longest rule that fits, else null (of equally long ones a block); and
    ``ruled``: its verdict."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[0] != BLOCK, r[1]))
    def chosen(value: int) -> Column:
        steps = reduce(lambda c, r: c.when(_fits(r[1]), F.lit(r[value])), longest, F)
        return steps.otherwise(F.lit(None).cast("string")) if longest else F.lit(None).cast("string")
    return rows.withColumn("rule", chosen(1)).withColumn("ruled", chosen(0))


def _entropy(text: Column) -> Column:
    """Bits per character.  The sorted characters are bound once; a run of equal ones ends
    where the next begins."""
    def runs(chars: Column) -> Column:
        n = F.size(chars)
        begins = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1))
        )
        def bits(at: Column) -> Column:
            share = F.transform(at, lambda s, k: (F.coalesce(F.get(at, k + 1), n) - s) / n)
            return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))
        return F.get(F.transform(F.array(begins), bits), F.lit(0))
    chars = F.array_sort(F.split(text, ""))
    return F.when(F.length(text) > 0, F.get(F.transform(F.array(chars), runs), F.lit(0))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Distinct ``url`` with its host, path, suffixes and features."""
    text = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    parts = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    counted = {
        "length": F.length(text), "host_length": F.length("host"), "path_length": F.length("path"),
        "labels": F.regexp_count("host", F.lit("[.]")), "depth": F.regexp_count("path", F.lit("/[^/]")),
        "digits": F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.length(text), F.lit(1)),
        "marks": F.regexp_count(text, F.lit("[-_~%@+]")), "capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "parameters": F.regexp_count(query, F.lit("[^&;]+")), "query_length": F.length(query),
        "entropy": _entropy(text), "suffix": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
    }
    return parts.withColumns({k: v if k in ("suffix", "domain") else v.cast("double") for k, v in counted.items()})


def _shares(labelled: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """For each suffix and fold how many of its labelled URLs, and blocked ones, there are."""
    counts = labelled.groupBy(key, "fold").agg(
        F.count("*").alias("n"), F.sum("blocked").alias("bad")
    )
    return scratch.write(counts, f"{key}-counts")


def _smoothed(bad: Column, n: Column, prior: float) -> Column:
    return (F.coalesce(bad, F.lit(0)) + PRIOR * prior) / (F.coalesce(n, F.lit(0)) + PRIOR)


def _with_shares(rows: DataFrame, counts: dict[str, DataFrame], prior: float, scratch: Scratch, own_fold: bool) -> DataFrame:
    """Add the share of blocked URLs of each suffix; without the row's own fold for rows that
    are learned from, so that no label tells itself."""
    for key, table in counts.items():
        total = table.groupBy(key).agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"))
        rows = rows.join(lookup_table(total, f"{key}-total", scratch), key, "left")
        n, bad = F.col("_n"), F.col("_bad")
        if own_fold:
            mine = table.withColumnsRenamed({"n": "_own_n", "bad": "_own_bad"})
            rows = rows.join(mine, [key, "fold"], "left")
            n, bad = n - F.coalesce("_own_n", F.lit(0)), bad - F.coalesce("_own_bad", F.lit(0))
        rows = rows.withColumn(f"{key}_share", _smoothed(bad, n, prior))
        rows = rows.drop("_n", "_bad", "_own_n", "_own_bad")
    return rows


def judge_urls(
    pages: DataFrame, rules=RULES, sample: int = SAMPLE, scratch: Scratch | None = None
) -> DataFrame:
    """A row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    ``score`` is the trees' probability that the URL is to be blocked; it decides where no
    rule fits (block from 0.5).  Distinct URLs are judged once, however many pages have
    them.  About ``sample`` of those with a rule, chosen by a hash, are learned from, each
    weighing the same.  If rules give one verdict only, that is the verdict for all; if
    they fit nothing, URLs are allowed; the score is then 1 or 0.

    A URL that is null or has no ``://`` has an empty host and path.  Repeated rows stay
    repeated; an empty table gives no row; further columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    rows = pages.select("page_id", "url")
    distinct = scratch.write(with_rules(lexical(rows.select("url").distinct()), rules), "urls")
    labelled = distinct.where("rule IS NOT NULL").withColumn("blocked", (F.col("ruled") == BLOCK).cast("int"))
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)))
    total, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if 0 < bad < total:
        prior = bad / total
        counts = {key: _shares(labelled, key, scratch) for key in ("suffix", "domain")}
        share = int(min(1.0, sample / total) * (1 << 30))
        chosen = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1 << 30)) < share)
        taught = _with_shares(chosen, counts, prior, scratch, own_fold=True)
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        # The sample is bounded: in one ordered partition the trees come out the same each time.
        taught = scratch.write(taught.select("url", "blocked", *FEATURES).coalesce(1).sortWithinPartitions("url"), "taught")
        trees = GBTClassifier(
            labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxMemoryInMB=64
        )
        model = trees.fit(assemble.transform(taught.coalesce(1)))
        scored = model.transform(assemble.transform(_with_shares(distinct, counts, prior, scratch, own_fold=False)))
        scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 9))
    else:
        scored = distinct.withColumn("score", F.lit(float(bad > 0)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    judged = lookup_table(
        scored.select(F.col("url").alias("_url"), "host", "path", "rule", verdict.alias("verdict"), "score"),
        "judged", scratch,
    )
    return rows.join(judged, F.col("url").eqNullSafe(F.col("_url"))).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )
