"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

All work is DataFrame and ``pyspark.ml`` operations. Features of a url: lengths, depth of the
path, digit ratios, entropy of host and path, counts of parameters, hyphens and labels, and
statistics of its suffix (how often the labelled urls of that suffix are blocked, smoothed),
taken over all labelled urls; a url that the trees are trained from is left out of its own
suffix's statistics. Only the fit of the trees is from a sample, of distinct urls of each kind.

Labelled urls: a labelled table may be given. Without one, the urls that a rule decides are
labelled by its verdict; the trees see no host names, only lexical features, and so carry the
judgement over to urls of the same make. Half of the sampled urls are shown to the trees as if
their suffix were not known, so that they also learn to judge urls of new suffixes.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import cut, small, table

# Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Bound of the labelled urls that the trees are trained from, half of it for each kind.
MAX_LABELLED = 20_000
TREES, DEPTH = 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio",
    "host_entropy", "path_entropy", "parameters", "longest_label", "suffix_blocked", "suffix_seen",
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest) by the text after the first ``://``; empty for a null url or none."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for h, p, verdict in rules:
        own = (host == h) | F.endswith(host, F.lit("." + h))
        entry = F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(own & F.startswith(path, F.lit(p)), entry))
    return F.array_max(F.array(*fits))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters; 0 for empty text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of the rule, suffix and lexical features of each url."""
    host, path, rest = split_url(F.col("url"))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"), host.alias("host"), path.alias("path"), rest.alias("_rest"))
    fit = rule_of(F.col("host"), F.col("path"))
    base = base.withColumn("_fit", fit).select("*", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("_verdict"))
    digits = lambda c: F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))
    ratio = lambda c: (digits(c) / F.greatest(F.length(c), F.lit(1))).cast("double")
    h, p, u, r = (F.col(c) for c in ("host", "path", "_url", "_rest"))
    labels = F.split(h, r"\.")
    return base.select(
        "page_id", "_url", "host", "path", "rule", "_verdict",
        F.when(h == "", F.lit("")).otherwise(F.concat(F.element_at(labels, -1), F.lit("/"), F.regexp_extract(p, r"^/?([^/]*)", 1))).alias("_suffix"),
        F.length(u).cast("double").alias("url_length"),
        F.length(h).cast("double").alias("host_length"),
        F.length(p).cast("double").alias("path_length"),
        F.length(r).cast("double").alias("query_length"),
        F.regexp_count(p, F.lit("/+[^/]")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        F.regexp_count(h, F.lit("-")).cast("double").alias("hyphens"),
        ratio(u).alias("digit_ratio"),
        ratio(h).alias("host_digit_ratio"),
        _entropy(h).alias("host_entropy"),
        _entropy(p).alias("path_entropy"),
        F.regexp_count(r, F.lit("[?&][^=&#]+=")).cast("double").alias("parameters"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
    )


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score.

    pages has ``page_id`` and ``url``; labelled has ``url`` and ``label`` (1: block, 0: allow;
    without it the rules label the pages' own urls). Other columns are not read. A null url, or
    one without ``://``, has empty host and path and no rule. Null page_ids are kept and rows that
    repeat are judged each. Where the labelled urls are none or all of one kind there is nothing
    to learn: the verdict is then that kind, allow where none. score is the trees' probability of
    block, null where there were none. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    rows = lexical(pages)
    if labelled is None:
        source = rows.select("_url", "_suffix", (F.col("_verdict") == "block").cast("double").alias("label"))
    else:
        source = lexical(labelled.where("url is not null").select(F.col("label").cast("double").alias("page_id"), "url")).select("_url", "_suffix", F.col("page_id").alias("label"))
    source = source.where("label is not null")
    kinds = {r["label"]: r["n"] for r in source.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        only = F.lit("block" if set(kinds) == {1.0} else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_verdict", only).alias("verdict"), F.lit(None).cast("double").alias("score"))

    overall = kinds[1.0] / sum(kinds.values())
    suffixes = small(cut(source.groupBy("_suffix").agg(F.sum("label").alias("_blocked"), F.count(F.lit(1)).cast("double").alias("_seen")), "suffixes"))
    # of each kind the distinct urls with the smallest hashes; their weights bring back copies and the kind's share of all rows
    distinct = cut(source.groupBy("_url", "label").agg(F.count(F.lit(1)).cast("double").alias("_copies")).withColumn("_cell", F.xxhash64("_url")), "distinct-urls")
    taken = [distinct.where(F.col("label") == k).orderBy("_cell", "_url").limit(MAX_LABELLED // 2) for k in (0.0, 1.0)]
    train = cut(taken[0].union(taken[1]), "labelled")
    held = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("_copies").alias("n")).collect()}
    weight = F.col("_copies") * F.when(F.col("label") == 1.0, F.lit(kinds[1.0] / held[1.0])).otherwise(F.lit(kinds[0.0] / held[0.0]))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")

    def featured(df: DataFrame) -> DataFrame:
        """With the suffix's statistics, without the row's own copies (_own urls, _own_blocked of them) where it is labelled."""
        joined = df.join(suffixes, "_suffix", "left").fillna(0.0, ["_blocked", "_seen"])
        seen = F.greatest(F.col("_seen") - F.col("_own"), F.lit(0.0))
        blocked = F.greatest(F.col("_blocked") - F.col("_own_blocked"), F.lit(0.0))
        return assemble.transform(joined.withColumns({"suffix_blocked": (blocked + 10 * overall) / (seen + 10), "suffix_seen": F.log1p(seen)}))

    shown = lexical(train.select(F.struct("label", weight.alias("weight"), "_copies", "_cell").alias("page_id"), F.col("_url").alias("url")))
    hidden = F.col("page_id._cell") % 2 == 0
    own = F.when(hidden, 0.0).otherwise(F.col("page_id._copies"))
    shown = shown.withColumns({"_suffix": F.when(~hidden, F.col("_suffix")), "label": F.col("page_id.label"), "_weight": F.col("page_id.weight"), "_own": own, "_own_blocked": own * F.col("page_id.label")})
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5)
    model = trees.fit(featured(shown).select("_features", "label", "_weight").coalesce(max(1, spark.sparkContext.defaultParallelism // 2)))
    rows = rows.withColumns({"_own": F.lit(0.0), "_own_blocked": F.lit(0.0)})
    scored = model.transform(featured(rows)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", verdict).alias("verdict"), F.round("score", 6).alias("score"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


QUERIES = {"op5_url_filter": op5_url_filter}
SQL: dict[str, str] = {}
