"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

A document's rate is its number of copies in expectation. Rates minimise the words' relative entropy to taking
each word once, under a word total for each source, rates of MOST at most, and one moment: the mix keeps the
corpus's mean logarithm of document lengths (a word's weight each), as far as the totals allow it. The convex dual
has a multiplier for each source and one for the moment; rates are exp(multiplier of the source + multiplier of the
moment * centred log length), MOST at most. Newton steps solve it: gradient and Hessian are sums over all documents,
added up by source in Spark, the Hessian being diagonal but for the moment's row and column, which a Schur complement
takes out; steps that don't lower the dual are halved, and the residual ends the iteration. Documents of one source
and size have one rate, so that sums run over a histogram. Systematic rounding, largest documents first, turns rates
into copies: a source's words are off by half its largest document at most, and by far less at the best of PHASES starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralume.llm.common import distributed_rank, materialize, small

#: Weights of sources in their order, repeating; share of all words; most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Relative residual of every word total that ends the iteration; Newton steps after which it is an error that it isn't reached.
RESIDUAL, STEPS = 1e-8, 200
#: Weight of the moment's multiplier in the dual, per word: the moment is kept where this and the totals allow it.
RIDGE = 1e-4
#: Starts of the systematic rounding that are tried for each source.
PHASES = 16
#: Documents of one source and size that are ranked together, about.
CELL_ROWS = 1024
_ONE = 1 << 28  # a rate of 1 in whole numbers


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add target to sources (source, source_size): share of all words by weight, MOST times the size at most.

    What a source can't take is shared again by weight; in the end a source has its bound or weight times
    one level, which is found in the order in which sources reach their bounds. Sources are ranked by code
    point, null last. Sources without words have target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("bound", most * F.col("source_size"))
    order = [F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()]
    w = Window.orderBy(*order)
    total = share * F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("bound").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (total - before) / rest)
    x = x.withColumn("level", F.max(F.when(F.col("bound") >= F.col("weight") * F.col("level"), F.col("level"))).over(Window.partitionBy()))
    return x.withColumn("target", F.least("bound", F.coalesce(F.col("weight") * F.col("level"), F.col("bound")))).drop("level", "bound")


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equal keys, the source null or not."""
    out = left["source"].eqNullSafe(right["source"])
    for k in keys:
        out = out & (left[k] == right[k])
    return out


def _total(x: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.coalesce(F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double"), F.lit(0.0))


def _tilted(cells: DataFrame, state: DataFrame, beta: float, most: float) -> DataFrame:
    """cells with target, alpha and eta, the logarithm of the rate without its bound."""
    s = state.select("source", "target", "source_size", "alpha")
    s = F.broadcast(s) if state.count() <= 10_000 else s
    return cells.join(s, _same(cells, s)).drop(s["source"]).withColumn("eta", F.col("alpha") + beta * F.col("g"))


def _rate(most: float) -> Column:
    bound = F.col("target") >= most * F.col("source_size") * (1 - RESIDUAL)
    return F.when(F.col("target") <= 0, 0.0).when(bound, most).otherwise(F.least(F.exp(F.least("eta", F.lit(math.log(most)))), F.lit(most)))


def _sums(cells: DataFrame, state: DataFrame, beta: float, most: float) -> DataFrame:
    """Of every source, what a Newton step needs: taken words m, first and second derivatives and its part of the dual."""
    x = _tilted(cells, state, beta, most).withColumn("rate", _rate(most)).withColumn("mass", F.col("words") * F.col("rate"))
    solved = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - RESIDUAL))
    bends = F.when(solved & (F.col("eta") < math.log(most)), F.col("mass")).otherwise(0.0)
    dual = F.when(solved, F.col("words") * (F.col("rate") + most * F.greatest(F.col("eta") - math.log(most), F.lit(0.0)))).otherwise(F.col("mass") * beta * F.col("g"))
    x = x.withColumns({"solved": solved, "bends": bends, "dual": dual})
    out = x.groupBy("source", "target", "source_size", "alpha", "solved").agg(
        _total(F.col("mass")).alias("m"), _total(F.col("mass") * F.col("g")).alias("mg"), _total(F.col("bends")).alias("h"), _total(F.col("bends") * F.col("g")).alias("c"), _total(F.col("bends") * F.col("g") * F.col("g")).alias("q"), _total(F.col("dual")).alias("dual")
    )
    return materialize(out)


def rates(cells: DataFrame, balanced: DataFrame, most: float = MOST) -> DataFrame:
    """cells (source, size, n) with target, source_size and rate, the solution of the dual; balanced: what targets gives."""
    words = F.col("size") * F.col("n")
    mean = cells.agg(F.sum(F.round(words * F.ln(1.0 + F.col("size")), 6).cast("decimal(38,6)")).cast("double"), F.sum(words)).first()
    total = float(mean[1] or 0)
    cells = cells.withColumns({"words": words, "g": F.ln(1.0 + F.col("size")) - (mean[0] / total if total else 0.0)})
    state = balanced.select("source", "target", "source_size", F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.ln(F.col("target") / F.col("source_size"))).otherwise(0.0).alias("alpha"))
    beta, old, share = 0.0, None, 1.0
    for _ in range(STEPS if total else 0):
        now = _sums(cells, state, beta, most)
        open_ = F.col("solved") & (F.col("h") > 0)
        off = F.col("m") - F.col("target")
        # One row: residuals, dual, and the Schur complement of the sources' multipliers.
        v = now.agg(
            F.max(F.when(F.col("solved"), F.abs(off) / F.col("target"))).alias("residual"),
            _total(F.col("mg")).alias("mg"),
            _total(F.col("dual") - F.when(F.col("solved"), F.col("alpha") * F.col("target")).otherwise(0.0)).alias("dual"),
            _total(F.when(open_, F.col("q") - F.col("c") * F.col("c") / F.col("h")).otherwise(0.0)).alias("bend"),
            _total(F.when(open_, F.col("c") * off / F.col("h")).otherwise(0.0)).alias("pull"),
        ).first()
        slope, dual = v["mg"] + RIDGE * total * beta, v["dual"] + RIDGE * total * beta * beta / 2
        if (v["residual"] or 0.0) <= RESIDUAL and abs(slope) <= RESIDUAL * total:
            break
        if old is not None and dual > old["dual"] + 1e-9 * abs(old["dual"]) and share > 1e-6:
            share /= 2
        else:
            old, share = {"dual": dual, "sums": now, "beta": beta, "step": -(slope - v["pull"]) / (v["bend"] + RIDGE * total)}, 1.0
        # A source all of whose documents are at their bound has no second derivative: its multiplier falls by the logarithm of the excess.
        step = F.when(open_, -(off + F.col("c") * old["step"]) / F.col("h")).when(F.col("solved"), F.ln(F.col("target") / F.col("m"))).otherwise(0.0)
        state = old["sums"].select("source", "target", "source_size", (F.col("alpha") + share * step).alias("alpha"))
        beta = old["beta"] + share * old["step"]
    else:
        if total:
            raise RuntimeError(f"no solution of the word totals after {STEPS} Newton steps")
    return _tilted(cells, state, beta, most).withColumn("rate", _rate(most)).drop("eta", "alpha", "words", "g")


def rounded(cells: DataFrame, most: float = MOST) -> DataFrame:
    """Add _r, the rate in whole numbers, and _at, where the source's sum of rates stands before the cell's documents, largest first."""
    x = cells.withColumn("_r", F.round(F.col("rate") * _ONE).cast("long"))
    ahead = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each size
    x = x.withColumn("_at", F.coalesce(F.pmod(F.sum((F.col("_r") * F.col("n")).cast("decimal(38,0)")).over(ahead), F.lit(_ONE).cast("decimal(38,0)")).cast("long"), F.lit(0).cast("long")))
    x = materialize(x)
    tried = x.withColumn("_phase", F.explode(F.array(*(F.lit(i * (_ONE // PHASES)) for i in range(PHASES)))))
    here = F.col("_at") + F.col("_phase")
    took = F.sum(F.col("size") * (F.floor((here + F.col("_r") * F.col("n")) / _ONE) - F.floor(here / _ONE)))
    best = tried.groupBy("source", "target", "_phase").agg(took.alias("took")).groupBy("source").agg(F.min_by("_phase", F.struct(F.abs(F.col("took") - F.col("target")), "_phase")).alias("_phase"))
    return materialize(x.join(best, _same(x, best)).drop(best["source"]).withColumn("_at", F.col("_at") + F.col("_phase")).drop("_phase"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to most) of every document; the same on every run.

    Null texts have size 0 and get copies like others of their source; a null source is one, the last.
    Repeated rows are documents of their own; very long texts count whole; other columns don't matter; no
    documents give no rows.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_h")))
    cells = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    balanced = materialize(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    cells = small(rounded(rates(cells, balanced, most), most), 96)
    x = sized.join(cells, _same(sized, cells, "size")).drop(cells["source"]).drop(cells["size"])
    # The place of a document among those of its source and size: in its bucket, and behind the buckets before.
    x = x.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_h"), F.ceil(F.col("n") / CELL_ROWS)))
    sizes = x.filter(F.col("n") > CELL_ROWS).groupBy("source", "size", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_o", F.sum("_c").over(Window.partitionBy("source", "size").orderBy("_b")) - F.col("_c")).drop("_c")
    before = small(materialize(before), 48)
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("source", "size", "_b").orderBy("doc_id", "_h")) - 1)
    x = x.join(before, _same(x, before, "size", "_b"), "left").drop(*(before[c] for c in ("source", "size", "_b")))
    here = F.col("_at") + F.col("_r") * (F.col("_k") + F.coalesce("_o", F.lit(0)))
    copies = F.least(F.floor((here + F.col("_r")) / _ONE) - F.floor(here / _ONE), F.lit(int(most))).cast("int")
    return x.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "_h")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, each row as often as the mix takes it (copies of 0: not at all).

    Of rows with one id, source and text, as many stand in the mix as it grants them together, dealt out evenly in
    the order of a hash of their other columns. Null ids and texts, and no documents, are nothing special.
    """
    rows = mix(docs, **how).groupBy("doc_id", "source", "_h").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    r = materialize(rows.withColumnsRenamed({"doc_id": "_id", "source": "_source", "_h": "_hash"}))
    d = docs.withColumn("_h", F.xxhash64("text"))
    taken = d.join(r, d["doc_id"].eqNullSafe(F.col("_id")) & (d["_h"] == F.col("_hash")) & d["source"].eqNullSafe(F.col("_source")))
    again = lambda x: x.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
    out = again(taken.filter("_rows = 1"))
    if not r.filter("_rows > 1").limit(1).count():
        return out
    dealt = materialize(taken.filter("_rows > 1").withColumn("_order", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))))
    dealt = distributed_rank(dealt.withColumn("_group", F.xxhash64("_id", "_source", "_hash")), ["_group"], ["_order"], dealt.count())
    upto = lambda k: F.floor(k * F.col("_copies") / F.col("_rows"))
    return out.unionByName(again(dealt.withColumn("_copies", upto(F.col("rank") + 1) - upto(F.col("rank")))))
