"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model (trigrams, smoothed by shorter ones) of all documents' words is the source; the
channel writes letters as look-alike signs, spaces them out or repeats them. Viterbi decoding finds the
best letters for every token that the channel may have touched; any other token has one reading only.
A logistic regression over the restored words and their beginnings scores a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralume.llm.common import bounded, materialize, sliced

#: Labelled documents that train the classifier, about (chosen by hash from all labelled rows).
TRAIN_ROWS = 20_000
#: Features kept by the classifier.
KEPT = 4096
#: Sizes by order of an array of counters that may stand in for exact counts, n-grams being hashed into it.
SLOTS = (1 << 12, 1 << 16, 1 << 18)
THRESHOLD = 0.3
#: Distinct words that a task holds; readings that a worker keeps.
FLUSH, CACHE = 50_000, 50_000

#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Negative log-probabilities of the channel: a sign for a letter, one repeated letter, any further one, a space inside a word.
SIGN, REPEAT, MORE, SPACED = 1.5, 3.0, 0.3, 0.2

_EDGE = ".,;:?\"'()[]{}<>«»…"
_TAIL = "!*#%&-_|=~^" + _EDGE
_HEAD = _TAIL.replace("!", "")
_SIGNS = "".join(c for c in LOOKALIKES if not c.isalnum())
_ONE = rf"(?:[^\W_]|[{re.escape(_SIGNS)}])"
#: One letter or sign at a time, from the start or after anything but a letter (and an apostrophe after one).
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_]['’])(?:{_ONE}[ ._*-]{{1,2}}){{2,}}{_ONE}(?![^\W_])")
#: What every such run holds; few other texts do.
_MAYBE_SPACED = re.compile(r"[ ._*-]\S[ ._*-]{1,2}\S(?![^\W_])")
_SPACED_HEAD = " " + "".join(c for c in _HEAD if c not in LOOKALIKES)
_TOUCHED = re.compile(r"(.)\1|[013456789@$!|+(€£¡*._ -]")
_DOUBLE = re.compile(r"(.)\1")
_LETTER = re.compile(r"[^\W\d_]")


def _key(gram: str) -> int:
    """A number below 2^63 for one to three characters, different for all."""
    k = 0
    for c in gram:
        k = k * 0x110000 + ord(c)
    return 4 * k + len(gram)


def _grams(words: Counter):
    """(keys, counts) of the last one, two and three characters at each place of the words, which are padded."""
    text = "  " + "".join(f"{w}  " for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    weight = np.repeat(np.array([0, *words.values()], np.int64), np.array([2, *(len(w) + 2 for w in words)]))[2:]
    a, b, z = (c[i : len(c) - 2 + i].astype(np.int64) for i in range(3))
    x, size = (a * 0x110000 + b) * 0x110000 + z, 0x110000**3
    for k in (3, 2, 1):  # shorter ones from the longer ones' counts
        x, of = np.unique(x % size if k < 3 else x, return_inverse=True)
        weight = np.bincount(of, weight, len(x)).astype(np.int64)
        yield 4 * x + k, weight
        size = 0x110000 ** (k - 1)


def _count(batches):
    words: Counter = Counter()

    def out():
        for keys, times in _grams(words) if words else ():
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["gram", "times"])
        words.clear()

    for b in sliced(batches, 0):
        for t in b.column(0).to_pylist():
            if t:
                words.update(t.lower().split())
                if len(words) > FLUSH:
                    yield from out()
    yield from out()


def language_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and exact counts of the n-grams of all words of all documents, 16 bytes for each distinct one."""
    rows = bounded(docs).select("text").mapInArrow(_count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    rows = materialize(rows).toArrow().sort_by("gram")
    return rows["gram"].to_numpy(), rows["times"].to_numpy()


class Decoder:
    """Viterbi decoding of a token's character lattice."""

    def __init__(self, counts):
        """counts: what language_model gives, or an array of sum(SLOTS) counters."""
        self.keys, self.counts = counts if isinstance(counts, tuple) else (None, counts)
        singles = counts[: SLOTS[0]] if self.keys is None else self.counts[self.keys % 4 == 1]
        self.total = max(1.0, float(singles.sum()))
        self.known: dict[tuple[str, str, str], float] = {}

    def times(self, gram: str) -> float:
        key = _key(gram)
        if self.keys is None:
            at = sum(SLOTS[: len(gram) - 1]) + (key * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % SLOTS[len(gram) - 1]
            return float(self.counts[at])
        at = self.keys.searchsorted(key)
        return float(self.counts[at]) if at < len(self.keys) and self.keys[at] == key else 0.0

    def cost(self, a: str, b: str, z: str) -> float:
        """-log P(z | a, b)."""
        got = self.known.get((a, b, z))
        if got is None:
            one, two, three = self.times(z), self.times(b + z), self.times(a + b + z)
            single, context = self.times(b), self.times(a + b)
            p = (one + 0.1) / (self.total + 100)
            p = (two + 5 * p) / (max(single, two) + 5)
            p = (three + 5 * p) / (max(context, three) + 5)
            got = self.known[a, b, z] = -math.log(p)
            if len(self.known) > CACHE:
                self.known.clear()
        return got

    def undouble(self, word: str, i: int) -> str:
        """What decode gives for letters of which one alone, at i, repeats the last: its two readings differ in five steps."""
        t, cost = "  " + word + " ", self.cost
        i += 2
        keep, drop = cost(t[i - 2], t[i - 1], t[i]) + cost(t[i - 1], t[i], t[i + 1]), REPEAT + cost(t[i - 2], t[i - 1], t[i + 1])
        if i + 2 < len(t):
            keep += cost(t[i], t[i + 1], t[i + 2])
            drop += cost(t[i - 1], t[i + 1], t[i + 2])
        return word[: i - 2] + word[i - 1 :] if drop < keep else word

    def decode(self, token: str) -> str:
        """The likeliest letters; states are the last two characters, so that the work is linear in the token."""
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {(" ", " "): (0.0, None)}
        spaced = bool(_SPACED.fullmatch(token))
        run, known = 0, self.known
        for i, c in enumerate(token):
            run = run + 1 if i and token[i - 1] == c else 1
            options = [(c, 0.0)] + [(z, SIGN) for z in LOOKALIKES.get(c, "")]
            if run > 1:
                options.append(("", REPEAT if run == 2 else MORE))
            if c in " ._*-":
                options.append(("", SPACED if spaced else 2 * SIGN))
            new: dict = {}
            for (a, b), (cost, back) in states.items():
                for z, price in options:
                    if z:
                        step = known.get((a, b, z))
                        key, value, trail = (b, z), cost + price + (self.cost(a, b, z) if step is None else step), (back, z)
                    else:
                        key, value, trail = (a, b), cost + price, back
                    if key not in new or value < new[key][0]:
                        new[key] = (value, trail)
            states = new
        _, trail = min(((cost + self.cost(a, b, " "), trail) for (a, b), (cost, trail) in states.items()), key=lambda x: x[0])
        out = []
        while trail:
            trail, z = trail
            out.append(z)
        return "".join(reversed(out))


def _one_double(token: str) -> int:
    """The place of the second letter of the only doubled letter of a word; -1 if there are more or longer runs."""
    found = -1
    for i in range(1, len(token)):
        if token[i] == token[i - 1]:
            if found >= 0:
                return -1
            found = i
    return found


class Restorer:
    """Restored words of a text, and their features; readings are kept by token."""

    def __init__(self, counts):
        self.decoder = Decoder(counts)

    def token(self, token: str) -> list[str]:
        """Restored words of a token in lower case: itself, or its best reading if the channel may have touched it."""
        word = token.lstrip(_SPACED_HEAD if " " in token else _HEAD).rstrip(_TAIL + " ")
        if word[-3:] == "$$$":
            word = word.rstrip("$").rstrip(_TAIL)
        if word.isalpha():
            if not _DOUBLE.search(word):
                return [word]
            if (i := _one_double(word)) > 0:
                return [self.decoder.undouble(word, i)]
        if " " in word and not _SPACED.fullmatch(word):
            return [w for t in word.split() for w in self.token(t)]
        if _TOUCHED.search(word) and _LETTER.search(word):
            word = self.decoder.decode(word)
        return [w for w in re.split(r"[\W_]+", word) if w]

    def text(self, text: str) -> str:
        """The whole text restored, tokens separated by spaces."""
        return " ".join(w for t in self.tokens(text) for w in self.token(t))

    @staticmethod
    def tokens(text: str) -> list[str]:
        """Tokens of a text in lower case; letters that are spaced out make one token."""
        text = text.lower()
        if not _MAYBE_SPACED.search(text):
            return text.split()
        out, end = [], 0
        for m in _SPACED.finditer(text):
            out += text[end : m.start()].split()
            out.append(m[0])
            end = m.end()
        return out + text[end:].split()

    def features(self, token: str, starts: set | None = None) -> set[str]:
        """Whole words (marked by $) and their beginnings of 3 to 6 letters; with starts, only of words that begin with one of these."""
        out = set()
        for w in self.token(token):
            if starts is None or (w + "$")[:3] in starts:
                out.update((w + "$", *(w[:k] for k in range(3, min(len(w), 6) + 1))))
        return out


def held_out() -> Column:
    """Rows whose labels are never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(text, label) of about that many labelled documents, chosen by hash from all whose label may be learned; equal texts count once.

    Null ids, labels or texts don't train; of several labels of an id the highest counts.
    """
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    x = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")  # rows ids, about, at 12 bytes
    return x.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def _features(batches, counts):
    r = Restorer(counts)
    for b in sliced(batches, 0):
        rows = []
        for t in b.column(0).to_pylist():
            out: set = set()
            for token in set(r.tokens(t)):
                out |= r.features(token)
            rows.append(sorted(out))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), b.column(1)], names=["features", "label"])


def _regress(rows: list[np.ndarray], y: np.ndarray, n: int, penalty: float = 0.5, steps: int = 400) -> np.ndarray:
    """Weights and (last) bias of an L2-penalised logistic regression on binary features, by accelerated gradient steps."""
    at = np.concatenate([np.concatenate([r, [n]]) for r in rows]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    w = v = np.zeros(n + 1)
    most = np.bincount(of).max()
    scale = 1 / (0.25 * most * np.minimum(np.bincount(at, minlength=n + 1), len(rows)) + penalty)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(of, v[at], len(rows))))
        slope = np.bincount(at, (p - y)[of], n + 1) + penalty * np.append(v[:-1], 0)
        new = v - scale * slope
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """The model: language model counts, which grow with the corpus's distinct n-grams, and at most KEPT features and their weights."""
    counts = language_model(docs)
    held = docs.sparkSession.sparkContext.broadcast(counts)
    x = training_rows(bounded(docs), labels, column, rows).mapInArrow(lambda it: _features(it, held.value), "features array<string>, label int").persist()
    sizes = {r[0]: r[1] for r in x.groupBy("label").count().collect()}
    yes, no = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    per = x.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") != 1).alias("b"))
    per = per.filter((F.col("a") >= 3) & (F.col("a") * max(1, no) > 2 * F.col("b") * max(1, yes)))
    gain = F.col("a") * F.log((F.col("a") + 0.5) / (F.col("b") + 0.5) * max(1, no) / max(1, yes))
    kept = sorted(r["f"] for r in per.orderBy(gain.desc(), "f").limit(KEPT).select("f").collect())
    place = {f: i for i, f in enumerate(kept)}

    def only(batches):
        for b in batches:
            f = [sorted(place[i] for i in r if i in place) for r in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), b.column(1)], names=["f", "label"])

    sample = bounded(x).mapInArrow(only, "f array<int>, label int").toArrow()  # rows times KEPT at most, most are far shorter
    x.unpersist()
    weights = np.array([0.0] * len(kept) + [math.log(yes + 0.5) - math.log(no + 0.5)])
    if kept and len(sample):
        rows = sorted(zip(sample["label"].to_pylist(), sample["f"].to_pylist()))
        weights = _regress([np.array(f, np.int64) for _, f in rows], np.array([float(y == 1) for y, _ in rows]), len(kept))
    return {"counts": counts, "kept": kept, "weights": weights}


class Scorer:
    def __init__(self, model: dict):
        self.restorer = Restorer(model["counts"])
        self.place = {f: i for i, f in enumerate(model["kept"])}
        self.starts = {f[:3] for f in model["kept"]}
        self.weights = model["weights"].tolist()
        self.readings: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        """Probability of toxicity; an empty text has the bias alone."""
        found: set[int] = set()
        readings = self.readings
        for token in set(self.restorer.tokens(text)):
            got = readings.get(token)
            if got is None:
                if len(readings) > CACHE:
                    readings.clear()
                got = tuple(self.place[f] for f in self.restorer.features(token, self.starts) if f in self.place)
                if len(token) < 64:
                    readings[token] = got
            if got:
                found.update(got)
        x = self.weights[-1] + math.fsum(self.weights[i] for i in found)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """The columns given, text among them, and a score from 0 to 1.

    A null text scores as an empty one, very long ones are read whole, repeated rows stay, and no documents give no
    rows. A column of the score's name is replaced.
    """
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(held.value)
        for b in sliced(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([scorer.score(t or "") for t in b.column(at).to_pylist()], pa.float64())], names=[*b.schema.names, name])

    return bounded(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    return with_score(docs, train(docs, labels), "_toxicity").filter(F.col("_toxicity") < threshold).drop("_toxicity")
