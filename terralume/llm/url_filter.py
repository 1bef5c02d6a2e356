"""URL filters: host and path rules, and a character language-model ratio for the rest. DataFrame functions only.

URLs that a rule accepts or rejects train two variable-order Markov models (contexts of 0 to ORDER
characters, each order smoothed by the next shorter one). The counts are exact and live in a written table
that grows with the corpus; the grams of the URLs are joined to it. The score is the difference of
log-likelihoods a character. Training URLs are dealt to FOLDS by a hash and scored by the models of the other
folds; a normal model over these held-back scores calibrates the score to a probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.llm.common import materialize, small

#: Fixed values: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
#: Weight of the shorter context's estimate, in characters seen.
SMOOTHING = 2.0
FOLDS = 4
#: The model that all folds train.
WHOLE = -1
_PAD = "\x01" * ORDER
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule (of equal ones the first by code point) that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, _, p = rule.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, r in rules:
        out = F.when(rule == r, F.lit(verdict)).otherwise(out)
    return out


def windows(text: Column) -> Column:
    """Every character with the ORDER before it; all digits count as one."""
    folded = F.concat(F.lit(_PAD), F.translate(text, "0123456789", "0000000000"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.substring(folded, i, F.lit(ORDER + 1)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(grams)


def counted(urls: DataFrame) -> DataFrame:
    """How often each character follows each context of 0 to ORDER characters: model, gram (context and character), yes, no.

    From rows (text, fold, label: 1 accepted, 0 rejected); a gram's length tells its order. Model WHOLE counts all
    folds, model i all but fold i.
    """
    whole = urls.select("fold", "label", F.explode(windows(F.col("text"))).alias("w")).groupBy("fold", "w").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    parts = F.array(*(F.substring("w", ORDER + 1 - k, k + 1) for k in range(ORDER + 1)))
    grams = whole.select("fold", "yes", "no", F.explode(parts).alias("gram")).groupBy("fold", "gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    models = F.filter(F.array(*map(F.lit, (WHOLE, *range(FOLDS)))), lambda m: m != F.col("fold"))
    return materialize(grams.select(F.explode(models).alias("model"), "gram", "yes", "no").groupBy("model", "gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))


def ratios(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """model, w and ratio (log-likelihood if accepted less that if rejected) of distinct windows (model, w).

    Each order's grams are joined to their counts, their contexts' and their estimate by the next shorter
    order; as grams are distinct, no key has more rows than there are characters.
    """
    p = None
    for k in range(ORDER + 1):
        here = counts.filter(F.char_length("gram") == k + 1)
        contexts = here.groupBy("model", F.substring("gram", 1, k).alias("context")).agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
        x = asked.select("model", F.substring("w", ORDER + 1 - k, k + 1).alias("gram")).distinct().withColumn("context", F.substring("gram", 1, k))
        x = x.join(here, ["model", "gram"], "left").join(contexts, ["model", "context"], "left")
        x = x.withColumn("shorter", F.substring("gram", 2, k)).join(p, ["model", "shorter"]) if k else x.withColumns({"p_yes": F.lit(1 / 64), "p_no": F.lit(1 / 64)})
        likely = lambda c: (F.coalesce(F.col(c), F.lit(0)) + SMOOTHING * F.col(f"p_{c}")) / (F.coalesce(F.col(f"all_{c}"), F.lit(0)) + SMOOTHING)
        x = x.select("model", "gram", likely("yes").alias("p_yes"), likely("no").alias("p_no"))
        p = x.withColumnRenamed("gram", "shorter")
    return materialize(x.select("model", F.col("gram").alias("w"), (F.ln("p_yes") - F.ln("p_no")).alias("ratio")))


def scores(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """k1, k2, s of distinct texts (k1, k2, text, model): the mean ratio of their windows; empty texts have no row.

    Ratios are added as whole numbers, so that their order doesn't matter.
    """
    grams = texts.select("k1", "k2", "model", F.explode(windows(F.col("text"))).alias("w"))
    found = ratios(materialize(grams.select("model", "w").distinct()), counts)
    fixed = F.round(F.col("ratio") * (1 << 36)).cast("long")
    return materialize(grams.join(small(found, 36), ["model", "w"]).groupBy("k1", "k2").agg((F.sum(fixed) / F.lit(float(1 << 36)) / F.count(F.lit(1))).alias("s")))


def calibrate(scored: DataFrame) -> dict:
    """The slope and cut of the probability, from rows (s, label) of training URLs that the score's model hasn't seen."""
    model = {"slope": 1.0, "cut": 0.0}
    by = {r[0]: r for r in scored.groupBy("label").agg(F.avg("s"), F.coalesce(F.var_pop("s"), F.lit(0.0)), F.count(F.lit(1))).collect()}
    if 0 in by and 1 in by and by[1][1] > by[0][1]:
        spread = (by[0][2] * by[0][3] + by[1][2] * by[1][3]) / (by[0][3] + by[1][3]) + 1e-6
        model["slope"], model["cut"] = (by[1][1] - by[0][1]) / spread, (by[1][1] + by[0][1]) / 2
    return model


def probability(score_: Column, model: dict) -> Column:
    """Calibrated probability that a URL is accepted."""
    return 1 / (1 + F.exp(-(score_ - model["cut"]) * model["slope"]))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), p_allow of every page.

    URLs that a rule decides have the probability that models without their fold give them; equal URLs share a fold.
    Null URLs and those without :// have an empty host and path and no rule; the model decides them from
    nothing, at its cut (allow). Repeated rows stay; other columns don't matter; no pages give no rows.
    """
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = materialize(urls.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")}))
    fold = F.pmod(F.col("k1"), F.lit(FOLDS)).cast("int")
    known = urls.filter("rule is not null").select("k1", "k2", "text", fold.alias("fold"), (rule_verdict(F.col("rule"), rules) == "allow").cast("int").alias("label"))
    if known.select("label").distinct().count() == 2:
        texts = materialize(urls.filter("text <> ''").select("k1", "k2", "text", F.when(F.col("rule").isNotNull(), fold).otherwise(WHOLE).alias("model")).dropDuplicates(["k1", "k2"]))
        scored = small(scores(texts, counted(known)), 40)
        model = calibrate(known.join(scored, ["k1", "k2"]))
        urls = urls.join(scored, ["k1", "k2"], "left")
    else:  # without training: 0
        model = {"slope": 1.0, "cut": 0.0}
        urls = urls.withColumn("s", F.lit(0.0))
    p = probability(F.coalesce(F.col("s"), F.lit(model["cut"])), model)
    out = urls.withColumn("p_allow", p)
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_allow")
