"""Balanced label propagation: documents of equal texts move towards one shard under capacity quotas.

Texts of more copies than half a shard (a few dozen at most) are laid first, on the driver: larger ones fill
whole shards, then every other one and every remainder goes whole into the shard that it fits best, and only
what fits nowhere is cut. All other documents start in a shard by hash, as many as the room left there. All
of one text in one starting shard are a unit, so that a text has 16 units at most, whatever its number of
copies, and the propagation joins units, not documents. In each step every text that is in several shards
names one that has room for all of it, if there is one, and moves there whole; where none has, its units
ask to move to the shard that holds most of it. Requests that fit are granted in order while the shard has
room, until none is left to grant: each grant makes a text whole or, if not, gathers it more, so that this ends.
Texts without copies have no edges and fill up what is left, so that the law holds exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralume.llm.common import distributed_rank, materialize

SHARDS = 16


def _lay(sizes: list[int], full: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where groups of these sizes go: (group, first member, past the last one, shard, first slot), as few pieces as may be."""
    free, out, rest = list(full), [], []

    def put(i: int, begin: int, n: int, s: int):
        out.append((i, begin, begin + n, s, full[s] - free[s]))
        free[s] -= n

    for n, i in sorted(((n, i) for i, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
        begin = 0
        while n - begin > max(full) and (empty := [s for s, f in enumerate(full) if f and free[s] == f]):
            s = min(empty, key=lambda s: (full[s], s))
            put(i, begin, full[s], s)
            begin += full[s]
        rest.append((n - begin, i, begin))
    for n, i, begin in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = [s for s, f in enumerate(free) if f >= n]
            s = min(fits, key=lambda s: (free[s], s)) if fits else max(range(len(free)), key=lambda s: (free[s], -s))
            k = min(n, free[s])
            put(i, begin, k, s)
            n, begin = n - k, begin + k
    return out


def _propagate(units: DataFrame, room: list[int]) -> DataFrame:
    """units (k1, k2, origin, weight): add shard, so that no shard's units weigh more than its room, if it can be so."""
    x = materialize(units.withColumn("shard", F.col("origin")))
    key = ["k1", "k2"]
    step = 0
    while True:
        load = {r[0]: int(r[1]) for r in x.groupBy("shard").agg(F.sum("weight")).collect()}  # a row for each shard
        left = [max(0, room[s] - load.get(s, 0)) for s in range(SHARDS)]
        space = F.array(*map(F.lit, left))
        widest = max(range(SHARDS), key=lambda s: left[s])
        held = x.groupBy(*key, "shard").agg(F.sum("weight").alias("held")).withColumn("all", F.sum("held").over(Window.partitionBy(*key)))
        held = held.filter("held < all").withColumn("fits", F.element_at(space, F.col("shard") + 1) >= F.col("all") - F.col("held"))
        best = held.groupBy(*key, "all").agg(F.max_by(F.struct("shard", "fits", "held"), F.struct("fits", "held", F.xxhash64("k1", F.lit(step), "shard"))).alias("b"))
        aside = ~F.col("b.fits") & (F.col("all") <= left[widest])  # fits where none of it is yet
        best = best.select(*key, F.when(aside, F.lit(widest)).otherwise(F.col("b.shard")).alias("to"), (F.col("b.fits") | aside).alias("whole"), F.when(aside, F.col("all")).otherwise(F.col("all") - F.col("b.held")).alias("need"))
        best = materialize(best)
        asks = best.filter("whole").select(*key, "to", F.lit(None).cast("int").alias("unit"), F.col("need").alias("weight"))
        if not asks.limit(1).count():
            asks = x.join(best, key).filter((F.col("to") != F.col("shard")) & (F.col("weight") <= F.element_at(space, F.col("to") + 1))).select(*key, "to", F.col("origin").alias("unit"), "weight")
        asks = materialize(asks)
        n = asks.count()
        if not n:
            return x
        ranked = distributed_rank(asks, ["to"], [*key, "unit"], n, "weight", salt=key)
        granted = materialize(ranked.filter(F.col("before") + F.col("weight") <= F.element_at(space, F.col("to") + 1)).select(*key, "to", "unit"))
        moved = x.join(granted, key, "left").withColumn("here", F.col("to").isNotNull() & (F.col("unit").isNull() | (F.col("unit") == F.col("origin"))))
        moved = moved.groupBy(*key, "origin", "weight", "shard").agg(F.max(F.when(F.col("here"), F.col("to"))).alias("to"))
        x = materialize(moved.select(*key, "origin", "weight", F.coalesce("to", "shard").alias("shard")))
        step += 1


def shard(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document, by the law of rows.

    Counts of shards are at most one apart. size is the text's UTF-8 bytes plus one, null has none; a null
    text equals only null texts. Repeated rows are documents of their own; no documents give no rows.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    missing = F.col("text").isNull().cast("int")
    rows = materialize(docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text", missing).alias("k1"), F.xxhash64(missing, "text", F.lit(7)).alias("k2")))
    total = rows.count()
    room = total // SHARDS
    full = [room + (s < total % SHARDS) for s in range(SHARDS)]
    light = max(1, room // 2)
    texts = materialize(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    heavy = texts.filter(F.col("copies") > light).orderBy("k1", "k2").collect()  # 2 * SHARDS texts, about, at most
    pieces = _lay([h["copies"] for h in heavy], full)
    taken = [sum(p[2] - p[1] for p in pieces if p[3] == s) for s in range(SHARDS)]
    rooms = [f - t for f, t in zip(full, taken)]
    origin, draw = F.lit(0), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(1, sum(rooms))))
    for s in range(SHARDS):
        if rooms[s]:
            origin = F.when(draw >= sum(rooms[:s]), F.lit(s)).otherwise(origin)
    rows = rows.withColumn("origin", origin)
    units = rows.groupBy("k1", "k2", "origin").agg(F.count(F.lit(1)).alias("weight")).join(texts.filter(F.col("copies") <= light).drop("copies"), ["k1", "k2"])
    linked = _propagate(units, rooms)
    place = F.col("shard")
    load = {r[0]: int(r[1]) for r in linked.groupBy("shard").agg(F.sum("weight")).collect()}
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(h["k1"], h["k2"], i) for i, h in enumerate(heavy)], "k1 long, k2 long, heavy int")
    labelled = rows.join(linked.select("k1", "k2", "origin", "shard"), ["k1", "k2", "origin"], "left").drop("origin")
    labelled = materialize(labelled.join(F.broadcast(numbers), ["k1", "k2"], "left").drop("k1", "k2"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot"]
    laid = distributed_rank(materialize(labelled.filter("heavy is not null").drop("shard")), ["heavy"], ["doc_id", "text_crc32", "size"], total)
    where = spark.createDataFrame(pieces, "piece int, first long, past long, shard int, at long")
    laid = laid.join(F.broadcast(where), (F.col("heavy") == F.col("piece")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    laid = laid.withColumn("slot", F.col("at") + F.col("rank") - F.col("first")).select(*out)
    labelled = labelled.filter("heavy is null").drop("heavy")
    # What has no edges, and what is over a shard's count, goes to open places in the order of a distributed rank.
    ranked = materialize(distributed_rank(labelled, ["shard"], ["doc_id", "text_crc32", "size"], total, salt=["doc_id", "text_crc32"]))
    here = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.coalesce(place, F.lit(0)) + 1)
    stays = place.isNotNull() & (F.col("rank") < here(rooms))
    settled = ranked.filter(stays).withColumn("slot", F.col("rank") + here(taken)).select(*out)
    open_ = ranked.filter(~F.coalesce(stays, F.lit(False))).select("doc_id", "size", "text_crc32")
    free, begin = [], 0
    for s in range(SHARDS):
        used = taken[s] + min(load.get(s, 0), rooms[s])
        if used < full[s]:
            free.append((begin, s, used))
            begin += full[s] - used
    open_ = distributed_rank(materialize(open_.withColumn("all", F.lit(0))), ["all"], ["doc_id", "text_crc32", "size"], total)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, s, used in free:
        after = F.col("rank") >= first
        to, slot = F.when(after, F.lit(s)).otherwise(to), F.when(after, F.col("rank") - first + used).otherwise(slot)
    open_ = open_.withColumn("shard", to).withColumn("slot", slot).select(*out)
    return settled.unionByName(open_).unionByName(laid)
