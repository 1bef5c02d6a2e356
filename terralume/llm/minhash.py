"""MinHash fingerprints: universal hash permutations over word shingles in numpy, bands joined in Spark.

A signature is the least value of each of PERMUTATIONS multiply-add hashes over a text's shingles; a
fingerprint has 16 mixed bits of each in hex. Equal signatures are equally likely as shared shingles. Texts whose
signatures agree in a band are candidates; of those, the ones of a verified similarity make up components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.llm.common import bounded, materialize, release, shingle_sets, sliced
from terralume.llm.ngram_join import COUNTER_BITS, PARITY, ROWS, SEEN, _node, components_of, resolve, summaries

WIDTH = 5
PERMUTATIONS = 128
#: Bands of so many rows each: at a similarity of 0.8, a pair shares a band with probability 0.998.
BANDS, BAND_ROWS = 21, 6
#: Documents of a range of ids, about, where there are many.
RANGE_ROWS = 1 << 16

_random = np.random.default_rng(20240229)
_A = _random.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """Least values (uint32) over a set of hashes; all ones for an empty set."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def _cut(sig: np.ndarray) -> np.ndarray:
    """16 bits of each value, mixed before: a least value of many hashes has upper bits that are nearly always 0."""
    x = (sig ^ (sig >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return ((x ^ (x >> np.uint32(16))) >> np.uint32(16)).astype(np.uint16)


def fingerprint(sig: np.ndarray) -> str:
    return _cut(sig).astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of equal places of two fingerprints, an estimate of the Jaccard similarity; two empty texts: 1."""
    return float(np.mean(_cut(x) == _cut(y)))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the following text's first as many (or all)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _range_of(d: Column, cuts: list[int]) -> Column:
    """The place of the last of the ascending cuts that isn't above d, by halving; the first one never is."""
    bounds = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step) <= d, at + step).otherwise(at))


def with_next(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, copy, h, component_id, link) sorted so that within a part each row's next is the next document.

    Documents are cut into ranges of doc_id; a range's first document is also copied to the end of the
    range before it, and the very first to the end of all. The texts are shuffled once; the driver sees one
    row for each range. Repeated ids are ordered by a hash of their text; null ids come first. The rows of
    linked (doc_id, h, component_id) come right before the documents they speak of and are marked as link.
    """
    spark = docs.sparkSession
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.select("doc_id", "text", F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("link"), least.alias("d"), F.xxhash64("text").alias("h"))
    ids = materialize(rows.select("d", "h"))
    total = ids.count()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS)
    cuts = sorted(set(ids.approxQuantile("d", [i / parts for i in range(1, parts)], 0.5 / parts))) if total else []
    cuts = [-(1 << 63)] + [int(c) for c in cuts if c > -(1 << 63)]
    heads = sorted((r[0], r[1]) for r in ids.withColumn("p", _range_of(F.col("d"), cuts)).groupBy("p").agg(F.min(F.struct("d", "h"))).collect())
    release(ids)
    links = linked.select("doc_id", F.lit(None).cast("string").alias("text"), "component_id", F.lit(True).alias("link"), least.alias("d"), "h")
    both = rows.unionByName(links).withColumn("part", _range_of(F.col("d"), cuts)).withColumn("copy", F.lit(False))
    if heads:
        firsts = spark.createDataFrame([(h[1]["d"], h[1]["h"], heads[i - 1][0]) for i, h in enumerate(heads)], "d long, h long, part int")
        again = rows.join(F.broadcast(firsts), ["d", "h"]).dropDuplicates(["d", "h"]).withColumn("copy", F.lit(True))
        both = both.unionByName(again)
    ordered = both.repartition(parts, "part").sortWithinPartitions("part", "copy", "d", "h", F.desc("link"))
    return ordered.select("part", "doc_id", "text", "copy", "h", "component_id", "link")


SIGNED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"


def _signed(batches):
    """From the rows of with_next: each document that isn't a copy, with what its next document and its link say."""
    held = None
    link = (None, None, None)
    names = [c.split()[0] for c in SIGNED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    for b in sliced(batches, 2):
        part, doc, text, copy, h, component, is_link = (b.column(i).to_pylist() for i in range(7))
        sigs = [signature(s) for s in shingle_sets(text, WIDTH)]
        pending = []
        for i, row in enumerate(zip(part, doc, text, copy, sigs)):
            if is_link[i]:
                link = (doc[i], h[i], component[i])
                continue
            if held is not None and not held[3] and held[0] == row[0]:
                pending.append((held, row))
            held = (*row, link[2] if link[:2] == (doc[i], h[i]) else doc[i])
        changed = [edited(x[2], y[2]) for x, y in pending]
        out = []
        for (x, y), t, s in zip(pending, changed, shingle_sets(changed, WIDTH)):
            e = x[4] if t == x[2] else signature(s)
            out.append((x[1], len(x[2]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(x[4]), fingerprint(e), likeness(x[4], e), likeness(x[4], y[4]), x[5]))
        cols = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id of every document.

    component_id is that of near_duplicates. A null text is empty; texts of fewer words than a shingle have one
    shingle, empty ones none, and two of those are alike (1). A single document is its own next. Repeated rows stay;
    very long texts are taken whole; other columns don't matter; no documents give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(grouped(docs, WIDTH, 80).filter("root is not null").select("doc_id", "h", "root"))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = materialize(rows.join(least, "root").filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h", "component_id").distinct())
    release(rows)
    return with_next(bounded(docs), linked).mapInArrow(_signed, SIGNED)


def _bands(batches, width: int):
    seen: set = set()  # nodes whose bands this task has given, not to give them again
    for b in sliced(batches, 0):
        token, node, n = [], [], []
        for s in shingle_sets(b.column(0).to_pylist(), width):
            if len(s) and (key := _node(s)) not in seen:
                if len(seen) < SEEN:
                    seen.add(key)
                sig = signature(s)
                for i in range(BANDS):
                    raw = bytes([i]) + sig[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes()
                    token.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True))
                node += [key] * BANDS
                n += [len(s)] * BANDS
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array([-1] * len(n), pa.int32())], names=["token", "node", "n", "pos"])


def _nodes(batches, width: int):
    for b in sliced(batches, 2):
        columns = summaries(b.column(0), b.column(1), list(shingle_sets(b.column(2).to_pylist(), width)))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "node", *PARITY, "wide"])


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h, n, node and root of every document, as ngram_join.grouped has them, from texts that share a band."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = materialize(bounded(docs).mapInArrow(lambda it: _nodes(it, width), ROWS))
    posts = materialize(bounded(docs).select("text").mapInArrow(lambda it: _bands(it, width), "token long, node binary, n int, pos int"))
    order = docs.sparkSession.sparkContext.broadcast(bytes(1 << COUNTER_BITS))
    return resolve(docs, rows, posts, width, percent, order)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: texts that share a band and whose verified Jaccard is at least percent / 100.

    Nulls, empty texts and repeats as in ngram_join.similar_groups.
    """
    return components_of(grouped(docs, width, percent))
