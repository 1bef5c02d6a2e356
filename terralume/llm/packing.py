"""Best-fit packing of token sequences with a swap-based local search.

Only how many pieces there are of each length decides a packing, so that the search runs on classes of
equal bins (contents, number of bins). There are as many lengths as a sequence holds tokens; a length of best
fit opens or cuts a few classes, and an exchange adds two at most, so that classes depend on the capacity and
the exchanges, not on the number of documents. Ranks in a length then say which bin a piece goes to.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralume.llm.common import bounded, distributed_rank, materialize, sliced

CAPACITY = 2048
SEPARATOR = 0

# The vocabulary's pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

@lru_cache(1)
def _encoder(path: str):
    """The byte-level BPE of a tokenizer file, its ids in the order of its merges, and its special strings."""
    import tiktoken

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers; a special string in it is its own id, as the tokenizer has it."""
    encoder, special = _encoder(path)
    ids = encoder.encode(text, allowed_special="all") if any(x in text for x in special) else encoder.encode_ordinary(text)
    return array("I", ids).tobytes()


def _pieces(batches, path: str, capacity: int):
    end = np.array([SEPARATOR], "<u4").tobytes()
    for batch in sliced(batches, 1):
        out = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = token_bytes(text or "", path) + end
            n = len(ids) // 4
            begin, k = 0, 0
            while begin < n:
                stop = begin + ((n - begin) % capacity or capacity)
                for x, v in zip(out, (doc, k, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop]))):
                    x.append(v)
                begin, k = stop, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents cut into pieces: doc_id, piece, start, length, ids_crc32. A null text is an empty one (one separator)."""
    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _pieces(b, tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Classes of bins by best fit, longest pieces first: {contents, longest first: number of bins}.

    A piece goes to the fullest bin that has room for it, else to a new one. Pieces of one length fill a bin
    as far as they go before the next one, as the bin stays the fullest with room.
    """
    open_: dict[int, Counter] = {}  # by room left
    gaps: list[int] = []

    def put(contents: tuple, gap: int, times: int):
        if times:
            if gap not in open_:
                open_[gap] = Counter()
                insort(gaps, gap)
            open_[gap][contents] += times

    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                most = capacity // length
                put((length,) * most, capacity - most * length, left // most)
                put((length,) * (left % most), capacity - left % most * length, int(left % most > 0))
                break
            gap = gaps[i]
            contents, times = next(iter(open_[gap].items()))
            most = min(left, gap // length)
            used = min(times, left // most)
            open_[gap][contents] -= used
            if not open_[gap][contents]:
                del open_[gap][contents]
                if not open_[gap]:
                    del open_[gap], gaps[i]
            put(contents + (length,) * most, gap - most * length, used)
            left -= used * most
    bins: Counter = Counter()
    for classes in open_.values():
        bins.update(classes)
    return bins


class _Pool:
    """Underfull classes of bins, and rows (class, a piece it may give or 0, fill) of all of them."""

    def __init__(self, bins: Counter):
        self.bins, self.names, self.at = Counter(), [], {}
        self.which, self.give, self.fill = (np.zeros(0, np.int64) for _ in range(3))
        for k, v in bins.items():
            self.add(k, v)

    def add(self, k: tuple, times: int):
        if k not in self.bins:
            give = np.array((0, *dict.fromkeys(k)), np.int64)
            self.at[k] = (len(self.give), len(self.give) + len(give))
            self.which = np.append(self.which, np.full(len(give), len(self.names)))
            self.give, self.fill = np.append(self.give, give), np.append(self.fill, np.full(len(give), sum(k)))
            self.names.append(k)
        self.bins[k] += times

    def take(self, k: tuple, times: int):
        self.bins[k] -= times
        if not self.bins[k]:
            del self.bins[k]
            a, b = self.at.pop(k)
            self.fill[a:b] = -1  # a class that is gone
            if (gone := self.fill < 0).sum() > 4096 + len(self.fill) // 2:
                kept, self.names, self.at = self.bins, [], {}
                self.which, self.give, self.fill = (x[:0] for x in (self.which, self.give, self.fill[~gone]))
                self.bins = Counter()
                for k, v in kept.items():
                    self.add(k, v)


def _exchange(donor: tuple, pool: _Pool, capacity: int):
    """What one bin of the class best gives (one or two pieces) to a bin at least as full, and gets back (a piece or 0); None if nothing gains."""
    fill = sum(donor)
    room = pool.fill >= fill
    if pool.bins[donor] < 2:
        a, b = pool.at[donor]
        room[a:b] = False
    offers = {y: (y,) for y in donor}
    pairs = {sum(p): p for p in combinations(donor, 2)}
    best = None
    for parts, moves in ((offers, True), (pairs, False)):
        for y, part in parts.items():
            d = y - pool.give
            gain = np.where(room & (d > 0) & (pool.fill + d <= capacity), d * (pool.fill - fill + d), 0)
            if not moves:
                gain[pool.give == 0] = 0  # two for none is two moves
            j = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[j] > 0 and (best is None or gain[j] > best[0]):
                best = (int(gain[j]), part, int(pool.give[j]), pool.names[pool.which[j]])
    return best and best[1:]


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchanges between underfull bins that raise the sum of squared fill, until bins empty or none helps.

    A bin, the least full ones first, gives one or two pieces for one (or none) of a fuller bin that has room for the
    difference, until it is empty or nothing gains. An exchange is done at once in as many pairs of equal bins as
    there are. The search goes through all underfull bins again and again; it ends at the lower bound, or when a
    whole turn has found no exchange. Every exchange raises a sum that can't pass capacity times all tokens.
    """
    out = Counter({k: v for k, v in bins.items() if sum(k) == capacity})
    pool = _Pool({k: v for k, v in bins.items() if sum(k) < capacity})
    fewest = -(-sum(sum(k) * v for k, v in bins.items()) // capacity)
    total, moved = sum(bins.values()), True
    while total > fewest and moved:
        moved = False
        for donor in sorted(pool.bins, key=lambda k: (sum(k), k)):
            while donor in pool.bins and total > fewest:
                if (move := _exchange(donor, pool, capacity)) is None:
                    break
                part, back, taker = move
                moved = True
                times = pool.bins[donor] // 2 if taker == donor else min(pool.bins[donor], pool.bins[taker])
                lost, won = list(donor), list(taker)
                for y in part:
                    lost.remove(y)
                    won.append(y)
                if back:
                    won.remove(back)
                    lost.append(back)
                for old in (donor, taker):
                    pool.take(old, times)
                lost, won = (tuple(sorted(x, reverse=True)) for x in (lost, won))
                for new in (lost, won):
                    if not new:
                        total -= times
                    elif sum(new) == capacity:
                        out[new] += times
                    else:
                        pool.add(new, times)
                donor = lost
    return out + pool.bins


def slots(bins: Counter) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for contents, times in sorted(bins.items()):
        at = 0
        for k in contents:
            rows.append((k, taken[k], sequence, at))
            taken[k] += times
            at += k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(items: DataFrame, capacity: int = CAPACITY, order: list | None = None) -> DataFrame:
    """Add sequence_id and offset to materialised items with a length from 1 to capacity.

    No items: no rows. Equal rows get places of their own. Sequences are gapless from offset 0.
    """
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # capacity rows at most
    plan = slots(local_search(best_fit(counts, capacity), capacity))
    order = order or [c for c in items.columns if c != "length"]
    ranked = distributed_rank(items, ["length"], order, sum(counts.values()))
    keys = (plan[:, 0] << 44) + plan[:, 1]

    def place(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = (t.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(plan[i, 2] + rank - plan[i, 1])).append_column("offset", pa.array(plan[i, 3]))
            yield from t.to_batches()

    return bounded(ranked).mapInArrow(place, items.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces with a place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Other columns don't matter. Null texts count as empty; null or repeated ids are rows like any other; very long
    texts are cut, whole; no documents give no rows.
    """
    return pack(materialize(pieces(docs, tokenizer, capacity)), capacity)
