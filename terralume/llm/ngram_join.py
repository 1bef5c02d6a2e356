"""Similarity self-join on word n-grams: rare-first prefixes with length, positional and suffix filters.

Texts with the same n-grams are one node. A node's prefix holds its rarest n-grams; nodes that are
similar enough share one of them. The order needs to be the same everywhere, not exact: how frequent an
n-gram is comes from counts in a table of fixed size. Only n-grams that are in two prefixes make postings.

Only components are asked for, so that pairs within one needn't be looked at. In every posting, nodes are
first held against the posting's smallest node, which then leaves it, and round by round against PIVOTS others,
which leave it too, while that still joins components. In the end the pairs of different components that share a
prefix n-gram are made. All joins ask that sizes, positions and a 512-bit parity sketch (its Hamming distance
never exceeds that of the sets) leave room for the overlap, and a pair that was verified once is not made again.
Of a pair's exact sets, the suffix filter first compares the parts of the suffixes behind the first common n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.llm.common import bounded, components, materialize, mix, release, shingle_sets, sliced, small

#: Bits of the hash that pick a counter of n-gram frequency; so many counters are broadcast as bytes.
COUNTER_BITS = 20
#: Shingles that a task counts before it hands its counts on.
FLUSH = 1 << 20
#: Nodes whose prefix a task remembers, not to emit it again.
SEEN = 1 << 17
#: Nodes that all others of a posting are held against in a round; rounds go on while one in GOES_ON nodes finds a link, about.
PIVOTS, GOES_ON = 16, 4
#: Parts of the suffix that the suffix filter compares.
PARTS = 16


def _node(s: np.ndarray) -> bytes:
    return int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5DEECE66D)))).to_bytes(8, "big")


PARITY = [f"p{i}" for i in range(8)]
ROWS = "doc_id long, h long, n long, node binary, " + ", ".join(f"{p} long" for p in PARITY) + ", wide array<long>"


def summaries(ids: pa.Array, hashes: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
    """Columns of ROWS: ids and hashes of texts, the sets' sizes, nodes and parities (wide: about a bit for each n-gram of large sets); an empty set has no node."""
    parity = np.zeros((len(sets), 8), np.int64)
    wide: list = [None] * len(sets)
    for i, s in enumerate(sets):
        bits = 1 << max(9, (len(s) - 1).bit_length() if len(s) else 0)
        odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
        parity[i] = np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, 512))).view(">i8")
        if bits > 512:
            wide[i] = np.packbits(odd).view(">i8").astype(np.int64)
    return [ids, hashes, pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), *(pa.array(parity[:, i]) for i in range(8)), pa.array(wide, pa.list_(pa.int64()))]


def _scan(batches, width: int):
    """Rows of documents (ROWS), and rows (counter, times) of n-grams met twice or more by the task."""
    names = ["doc_id", "h", "n", "node", *PARITY, "wide", "counter", "times"]
    held: list = []
    size = 0

    def counts():
        tokens, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = times > 1
        per = np.bincount((tokens[often] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), times[often], 1 << COUNTER_BITS)
        at = np.flatnonzero(per)
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(at), pa.binary()), *[none] * 8, pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at, pa.int32()), pa.array(per[at].astype(np.int64))], names=names)

    for b in sliced(batches, 2):
        sets = list(shingle_sets(b.column(2).to_pylist(), width))
        yield pa.RecordBatch.from_arrays([*summaries(b.column(0), b.column(1), sets), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())], names=names)
        held += sets
        size += sum(map(len, sets))
        if size > FLUSH:
            yield counts()
            held, size = [], 0
    yield counts()


def _rare_first(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, often[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))]


def _prefixes(batches, width: int, percent: int, rarity: bytes):
    often = np.frombuffer(rarity, np.uint8)
    seen: set = set()
    for b in sliced(batches, 0):
        token, node, n, pos = [], [], [], []
        for s in shingle_sets(b.column(0).to_pylist(), width):
            if not len(s) or (key := _node(s)) in seen:
                continue
            if len(seen) < SEEN:
                seen.add(key)
            k = len(s) - -(-percent * len(s) // 100) + 1
            token.append(_rare_first(s, often)[:k])
            node.append((key, k))
            n.append(np.full(k, len(s)))
            pos.append(np.arange(k))
        if token:
            dictionary = pa.array([key for key, _ in node], pa.binary())
            nodes = dictionary.take(pa.array(np.repeat(np.arange(len(node)), [k for _, k in node])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), nodes, pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(pos), pa.int32())], names=["token", "node", "n", "pos"])


def _sets(batches, width: int, rarity: bytes):
    """(node, grams, rare first) of rows (node, text); a task gives a node once."""
    often = np.frombuffer(rarity, np.uint8)
    seen: set = set()
    for b in sliced(batches, 1):
        nodes = b.column(0).to_pylist()
        fresh = [i for i, k in enumerate(nodes) if not (k in seen or seen.add(k))]
        if len(seen) > SEEN:
            seen.clear()
        sets = shingle_sets([b.column(1)[i].as_py() for i in fresh], width)
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in fresh], pa.binary()), pa.array([_rare_first(s, often).tobytes() for s in sets], pa.binary())], names=["node", "grams"])


def suffix_distance(x: np.ndarray, y: np.ndarray) -> int:
    """At least how many elements two sets of hashes don't share: what the sizes of their parts differ by, parts being ranges of hashes."""
    part = lambda s: np.bincount((s >> np.uint64(64 - (PARTS - 1).bit_length())).astype(np.int64), minlength=PARTS)
    return int(np.abs(part(x) - part(y)).sum())


def similar(x: np.ndarray, y: np.ndarray, at_x: int, at_y: int, percent: int) -> bool:
    """Whether two sets (rare first) have a Jaccard similarity of percent / 100, at_x and at_y being the places of their first common element.

    Below 0: places aren't known, and the whole sets are the suffixes. What stands before the places has nothing
    in common, hence the suffixes behind them may differ by the rest of the distance only.
    """
    before = max(0, at_x) + max(0, at_y)
    if (100 + percent) * (before + suffix_distance(x[at_x + 1 :], y[at_y + 1 :])) > (100 - percent) * (len(x) + len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(batches, percent: int):
    for b in sliced(batches, 4, 1 << 24):
        a_at, b_at = b.column(2).to_pylist(), b.column(3).to_pylist()
        grams = lambda c, i: np.frombuffer(b.column(c)[i].as_buffer(), np.uint64)  # noqa: B023, E731
        keep = [similar(grams(4, i), grams(5, i), a_at[i], b_at[i], percent) for i in range(len(b))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, rarity) -> DataFrame:
    """The links (a, b) among materialised distinct pairs (a, b, pos_a, pos_b) by the exact sets; only texts of nodes in pairs are looked at."""
    wide = nodes.select("node", F.col("n").alias("n"), "wide")
    both = pairs.join(_sided(wide, "a"), F.col("a") == F.col("node_a")).join(_sided(wide, "b"), F.col("b") == F.col("node_b"))
    distance = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    fits = (100 + percent) * distance <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    pairs = materialize(both.filter(F.when(F.size("wide_a") == F.size("wide_b"), fits).otherwise(True)).select("a", "b", "pos_a", "pos_b"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(ends.join(nodes, "node").select("node", F.col("at.doc_id").alias("_id"), F.col("at.h").alias("_h")))
    found = docs.join(small(wanted, 48), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "text")
    sets = materialize(bounded(found).mapInArrow(lambda it: _sets(it, width, rarity.value), "node binary, grams binary"))
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    links = materialize(bounded(x).select("a", "b", "pos_a", "pos_b", "ga", "gb").mapInArrow(lambda it: _verified(it, percent), "a binary, b binary"))
    release(pairs, wanted, sets)
    return links


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns))


def _room(percent: int) -> Column:
    """Whether sizes and parities of two nodes (_a, _b) leave room for the similarity."""
    distance = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY[1:]), F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    size = F.col("n_a") + F.col("n_b")
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * distance <= (100 - percent) * size)


def _ahead(percent: int) -> Column:
    """Whether room for the overlap is left from this common n-gram on; for the first one, that is the positional filter."""
    return (100 + percent) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= percent * (F.col("n_a") + F.col("n_b"))


def _pairs(met: DataFrame, first: bool) -> DataFrame:
    """Distinct pairs (a, b, pos_a, pos_b), a > b, of rows (node_a, pos_a, node_b, pos_b); places are known if pairs met at all their common n-grams."""
    turned = F.col("node_a") < F.col("node_b")
    side = lambda x, y: F.struct(F.col(f"pos_{x}").alias("pos_a"), F.col(f"pos_{y}").alias("pos_b"))
    at = F.when(turned, side("b", "a")).otherwise(side("a", "b")) if first else F.struct(F.lit(-1).alias("pos_a"), F.lit(-1).alias("pos_b"))
    x = met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"), at.alias("at"))
    return x.groupBy("a", "b").agg(F.min("at").alias("at")).select("a", "b", "at.pos_a", "at.pos_b")


def _unsettled(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of postings whose nodes have two roots or more; adds root."""
    x = posts.join(small(roots, 64), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = x.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    return x.join(ends.select("token"), "token")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n, node and root of every document; equal roots are one component, rows without shingles have none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    scan = materialize(bounded(docs).mapInArrow(lambda it: _scan(it, width), ROWS + ", counter int, times long"))
    rows = scan.filter("counter is null").drop("counter", "times")
    often = scan.filter("counter is not null").groupBy("counter").agg(F.sum("times").alias("times")).toArrow()  # 2 ** COUNTER_BITS rows at most
    table = np.zeros(1 << COUNTER_BITS, np.uint8)
    table[often["counter"].to_numpy()] = np.log2(1 + often["times"].to_numpy().astype(np.float64)).astype(np.uint8)
    rarity = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    posts = bounded(docs).select("text").mapInArrow(lambda it: _prefixes(it, width, percent, rarity.value), "token long, node binary, n int, pos int")
    out = resolve(docs, rows, posts, width, percent, rarity)
    rarity.unpersist()
    return out


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; Jaccard of at least percent / 100 links two.

    Null, empty and blank texts have no shingles and link with nothing, their own component. Rows with a
    null doc_id are linked like any other; a component of such rows alone is null. Repeated ids are rows
    like any other, very long texts are taken whole, other columns don't matter, and no documents give no rows.
    """
    return components_of(grouped(docs, width, percent))


def components_of(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id from what grouped gives."""
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def resolve(docs: DataFrame, rows: DataFrame, posts: DataFrame, width: int, percent: int, rarity) -> DataFrame:
    """The rows (ROWS) as doc_id, h, n, node, root, from postings (token, node, n, pos); all links are verified on exact sets.

    docs: doc_id, h, text. pos below 0: places aren't known. posts is read twice.
    """
    often = posts.groupBy("token").count().filter("count > 1").select("token")
    posts = materialize(posts.join(often, "token").distinct())
    nodes = materialize(rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("at"), *(F.first(c).alias(c) for c in ("n", *PARITY, "wide"))))
    known = nodes.drop("at", "wide")

    first = posts.groupBy("token").agg(F.min(F.struct("node", "n", "pos")).alias("f"), F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    met = materialize(posts.join(first, "token").filter("node > f.node").select("token", "node", "n", "pos", "nodes", F.col("f.node").alias("node_b"), F.col("f.n").alias("n_b"), F.col("f.pos").alias("pos_b")))
    leads = _pairs(met.withColumnsRenamed({"node": "node_a", "n": "n_a", "pos": "pos_a"}).filter(_ahead(percent)), False)
    leads = leads.join(_sided(known, "a"), F.col("a") == F.col("node_a")).join(_sided(known, "b"), F.col("b") == F.col("node_b"))
    tried = materialize(leads.filter(_room(percent)).select("a", "b", "pos_a", "pos_b"))
    release(posts)
    written = [tried]
    roots = components(verify(docs, nodes, tried, width, percent, rarity))

    # A node that all others of a posting have been held against leaves it.
    left = _unsettled(met.filter("nodes > 2").select("token", "node", "pos"), roots).drop("root").join(known, "node")
    last = met
    fits = (F.col("token_a") == F.col("token_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("node_a") != F.col("node_b")) & _ahead(percent) & _room(percent)
    turn, ends = 0, False
    while not ends:
        mixed = materialize(_unsettled(left, roots))
        release(last)
        last = mixed
        open_ = mixed.select("node").distinct().count()
        if not open_:
            break
        ends = turn < 0
        if ends:
            met = _sided(mixed, "a").join(_sided(mixed, "b"), fits & (F.col("node_a") > F.col("node_b")))
        else:
            pivots = mixed.groupBy("token", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS))).agg(F.min("node").alias("node")).select("token", "node")
            met = _sided(mixed, "a").join(_sided(mixed.join(pivots, ["token", "node"], "left_semi"), "b"), fits)
            left = mixed.join(pivots, ["token", "node"], "left_anti").drop("root")
        pairs = materialize(_pairs(met, ends).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        written.append(pairs)
        links = verify(docs, nodes, pairs, width, percent, rarity)
        found = links.count()
        if found:
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        turn = turn + 1 if found * GOES_ON >= open_ else -1
    release(last, nodes, *written)

    return rows.select("doc_id", "h", "n", "node").join(roots, "node", "left").select("doc_id", "h", "n", "node", F.when(F.col("node").isNotNull(), F.coalesce("root", "node")).alias("root"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, one row of each component: of the smallest doc_id (nulls last) and, of its texts, the smallest hash.

    Of repeated rows of that id and text, one stays. Rows without shingles (null, empty, blank) link with nothing
    and all stay, repeats too. No documents give no rows.
    """
    rows = materialize(grouped(docs, width, percent).filter("root is not null").select("doc_id", "h", "root"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = rows.groupBy("root").agg(F.min(key).alias("best"), F.count(F.lit(1)).alias("rows"))
    groups = best.filter("rows > 1").select("root", "best")
    gone = rows.join(groups, "root").filter(key != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    gone = small(materialize(gone), 24)
    x = docs.withColumn("_text_hash", F.xxhash64("text"))
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h"))
    kept = x.join(gone, at, "left_anti")
    again = materialize(rows.join(groups, "root").filter(key == F.col("best")).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).count().filter("count > 1").drop("count"))
    if not again.limit(1).count():
        return kept.drop("_text_hash")
    again = small(again, 24)
    one = kept.join(again, at, "left_semi").groupBy("doc_id", "_text_hash").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return kept.join(again, at, "left_anti").drop("_text_hash").unionByName(one.select("row.*"))
