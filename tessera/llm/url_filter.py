"""URL filter, with DataFrame functions alone: rules by host and path, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models of characters are trained on the URLs that the rules allow and on those that they block.
A URL's score is the mean logarithm of the ratio of its characters' probabilities; a threshold calibrated on held-out URLs decides.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, col, joined, saved

#: Up to so many distinct grams (some 50 bytes each), the model is broadcast; beyond, it is joined by shuffle.
BROADCAST_GRAMS = 300_000
#: Characters that stand before and after a URL; contexts have up to three characters.
BEGIN, END, ORDER = "^^^", "$", 4


def rest_of(url: Column) -> Column:
    """What follows the first "://"; empty without one, and for a null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path prefix, as one string) that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda x: len(x[0])):
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(text: Column) -> Column:
    """The grams of ORDER characters of the text between BEGIN and END, one for each of its characters and END."""
    whole = F.concat(F.lit(BEGIN), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(whole) - (ORDER - 1)), lambda i: F.substring(whole, i, F.lit(ORDER)))


def gram_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each gram g of `wanted`: ratio, the logarithm of its last character's probability after the others, accepted over rejected.

    counts: g, a, r: how often the accepted and rejected URLs have the gram. Probabilities of each order are interpolated with the next
    lower order by the number of distinct successors of the context (Witten and Bell); a context never seen leaves the lower order's.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    all_of = tables[1].agg(*[f(c).alias(f"{n}{c}") for c in "ar" for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))]).first()
    out = wanted.withColumn("last", F.substring("g", ORDER, 1)).join(tables[1].select(F.col("g").alias("last"), *[F.col(c).alias(f"{c}1") for c in "ar"]), "last", "left")
    p = {c: (F.coalesce(f"{c}1", F.lit(0)) + F.lit((all_of[f"t{c}"] + 1) / 256)) / F.lit(float((all_of[f"n{c}"] or 0) + all_of[f"t{c}"] + 1)) for c in "ar"}
    for k in range(2, ORDER + 1):
        contexts = tables[k].groupBy(F.substring("g", 1, k - 1).alias(f"h{k}")).agg(*[f(c).alias(f"{n}{c}{k}") for c in "ar" for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))])
        of_gram = tables[k].select(F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in "ar"])
        out = out.withColumn(f"g{k}", F.substring("g", ORDER - k + 1, k)).withColumn(f"h{k}", F.substring("g", ORDER - k + 1, k - 1)).join(of_gram, f"g{k}", "left").join(contexts, f"h{k}", "left")
        p = {c: F.when(F.coalesce(f"n{c}{k}", F.lit(0)) > 0, (F.coalesce(f"{c}{k}", F.lit(0)) + F.col(f"t{c}{k}") * p[c]) / (F.col(f"n{c}{k}") + F.col(f"t{c}{k}"))).otherwise(p[c]) for c in "ar"}
    return out.select("g", (F.ln(p["a"]) - F.ln(p["r"])).alias("ratio"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: its id, host, path, rule, verdict (allow or block) and score (the mean log ratio; null where a rule decides).

    rules: (host and path prefix, "allow" or "block"), a list as short as a person writes. The longest rule that fits decides. Distinct
    URLs that a rule decides train the models, but for three sixteenths, by a hash, which calibrate the threshold: the point between
    the mean scores of held-out accepted and rejected URLs that is as many deviations from either. Without held-out URLs of both
    verdicts, the model allows everything.

    Edge cases: null URLs and those without "://" have empty host and path and are scored as the empty URL; repeated rows stay, with
    equal verdicts; whole URLs count, however long; an empty table gives an empty table; other columns are ignored.
    """
    rest = rest_of(col(url_col))
    rows = pages.select(col(id_col).alias("id"), F.coalesce(rest, F.lit("")).alias("rest"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    # Rows that no rule decides are joined to the scores of their URLs, of which one, such as the empty one, may be very common.
    judged = rows.withColumns({"host": host_of(F.col("rest")), "path": path_of(F.col("rest"))}).withColumn("rule", rule).withColumn("says", verdict)
    distinct = saved(judged.select("rest", "says").distinct().withColumn("held", F.substring(F.md5("rest"), 1, 1).isin("0", "1", "2")), "urls")
    trains = distinct.filter(F.col("says").isNotNull() & ~F.col("held"))
    counts = saved(trains.select("says", F.explode(grams(F.col("rest"))).alias("g")).groupBy("g").agg(F.count_if(F.col("says") == "allow").alias("a"), F.count_if(F.col("says") == "block").alias("r")), "grams")
    scored = distinct.filter(F.col("says").isNull() | F.col("held")).select("rest", "says", F.explode(grams(F.col("rest"))).alias("g"))
    ratios = saved(gram_ratios(counts, scored.select("g").distinct()), "ratios")
    ratios = F.broadcast(ratios) if ratios.count() <= BROADCAST_GRAMS else ratios
    scores = saved(scored.join(ratios, "g").groupBy("rest", "says").agg(F.avg("ratio").alias("score")), "scores")
    by = {r.says: r for r in scores.filter("says is not null").groupBy("says").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation")).collect()}
    threshold = float("-inf")
    if len(by) == 2:
        a, r = by["allow"], by["block"]
        both = a.deviation + r.deviation
        threshold = (a.mean * r.deviation + r.mean * a.deviation) / both if both else (a.mean + r.mean) / 2
    own = scores.filter("says is null").select("rest", "score", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("method"))
    nothing = F.lit(None).cast("double")
    ruled_ = judged.filter("says is not null").select("id", "host", "path", "rule", F.col("says").alias("verdict"), nothing.alias("score"))
    scored_ = joined(judged.filter("says is null"), own, ["rest"]).select("id", "host", "path", "rule", F.col("method").alias("verdict"), "score")
    return ruled_.unionAll(scored_).withColumnRenamed("id", id_col)
