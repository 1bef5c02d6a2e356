"""Similarity joins, fingerprints and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from terralume.llm import common, minhash, ngram_join


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 4, 20, 60, 120]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        t = " ".join(w)
        rows.append((i, t.upper() if r.random() < 0.2 else t.replace(" ", r.choice([" ", "\n", "\t "]))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "word"), (n + 4, "WORD")]


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_similar_groups_equal_brute_force(docs_of, seed, width, percent):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in ngram_join.similar_groups(docs_of(rows), width, percent).collect())
    assert got == brute(rows, width, percent)


def test_similar_groups_edges(docs_of):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(5, long), (3, long + " y"), (3, long), (None, long), (None, long + " z"), (7, None), (None, ""), (9, "é\u00a0b c d e")]
    got = sorted(map(str, (tuple(r) for r in ngram_join.similar_groups(docs_of(rows), 4, 85).collect())))
    assert got == sorted(map(str, [(5, 4997, 3), (3, 4998, 3), (3, 4997, 3), (None, 4997, 3), (None, 4998, 3), (7, 0, 7), (None, 0, None), (9, 1, 9)]))
    assert ngram_join.similar_groups(docs_of([]), 4, 85).collect() == []


def edited_copies(seed, n, words, most):
    """Copies of one text with up to so many words replaced: many pairs on either side of the threshold, and one passage in all of them."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(1, most)):
            w[r.randrange(words)] = f"e{r.randrange(300)}"
        out.append((i, " ".join(w + [f"t{i % 7}"])))
    return out


@pytest.mark.parametrize("seed,words,most", [(1, 90, 7), (2, 40, 4)])
def test_hot_group_equals_brute_force_and_no_pair_is_verified_twice(docs_of, monkeypatch, seed, words, most):
    rows = edited_copies(seed, 220, words, most)
    asked = []
    verify = ngram_join.verify

    def watched(docs, nodes, pairs, *how):
        asked.extend((bytes(r.a), bytes(r.b)) for r in pairs.collect())
        return verify(docs, nodes, pairs, *how)

    monkeypatch.setattr(ngram_join, "verify", watched)
    got = sorted(tuple(r) for r in ngram_join.similar_groups(docs_of(rows), 4, 85).collect())
    assert got == brute(rows, 4, 85)
    assert len(asked) == len(set(asked)) and all(a > b for a, b in asked)


def test_suffix_filter_never_rejects_a_similar_pair():
    r = np.random.default_rng(3)
    rejected = 0
    for _ in range(400):
        x = r.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
        y = np.concatenate([x[r.random(60) < 0.93], r.integers(0, 1 << 63, r.integers(0, 6), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        true = 100 * both >= 85 * (len(x) + len(y) - both)
        order = {v: k for k, v in enumerate(r.permutation(np.union1d(x, y)))}
        x, y = (np.array(sorted(s.tolist(), key=order.get), np.uint64) for s in (x, y))
        first = min(set(x.tolist()) & set(y.tolist()), key=order.get)
        i, j = (int(np.flatnonzero(s == np.uint64(first))[0]) for s in (x, y))
        assert ngram_join.similar(x, y, i, j, 85) == true == ngram_join.similar(x, y, -1, -1, 85)
        rejected += i + j + ngram_join.suffix_distance(x[i + 1 :], y[j + 1 :]) > 15 * (len(x) + len(y)) / 185
        assert ngram_join.suffix_distance(x, y) <= len(x) + len(y) - 2 * both
    assert rejected > 20


def kept_of(rows, width=5, percent=80):
    """Brute force of keep_one: by component of texts, the smallest id (nulls last)."""
    texts = [(i, t) for i, (_, t) in enumerate(rows)]
    out, best = [], {}
    for i, n, c in brute(texts, width, percent):
        if not n:
            out.append(rows[i])
        else:
            best.setdefault(c, []).append(rows[i])
    for group in best.values():
        d = min((d is None, d or 0) for d, _ in group)
        out.append(("one of", sorted({t for x, t in group if (x is None, x or 0) == d})))
    return out


def test_keep_one_equals_brute_force(docs_of):
    a, b, c = "a b c d e f g h i j k l", "m n o p q r s t u v w", "unique words that stand in this text alone"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (4, None), (4, None), (5, ""), (None, b), (None, "x y z x y q"), (None, "x y z x y q"), (7, b)]
    rows += [(i + 100, t) for i, t in corpus(6, 60)]
    out = ngram_join.keep_one(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    want = kept_of(rows)
    assert len(got) == len(want)
    for w in want:
        if w[0] == "one of":
            assert sum(t in w[1] for _, t in got) == 1
        else:
            assert got.count(w) == want.count(w)
    assert (3, c) in got and (3, b) in got and (2, a) not in got and (None, b) not in got
    assert ngram_join.keep_one(docs_of([])).collect() == []


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(1, 1)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {row.node: row.root for row in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_word_hashes_tell_words_apart():
    texts = ["one two  three\x0bfour", None, "", "TWO\nfive\x1cx", "É é"]
    h, bounds = common.word_hashes(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    words = b"\x00".join((t or "").encode().translate(bytes(32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))).lower() + b" " for t in texts)
    flat = [w for w in words.replace(b"\x00", b"").split(b" ") if w]
    assert len(h) == len(flat) and bounds.tolist() == [0, 4, 4, 4, 6, 8]
    assert {(a == b) == (x == y) for a, x in zip(h.tolist(), flat) for b, y in zip(h.tolist(), flat)} == {True}


def test_fingerprints(docs_of):
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(0, 90))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1003, ""), (1006, texts[0] + "é"), (1009, texts[0])]
    got = {x.doc_id: x for x in minhash.fingerprints(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows)
    for (d, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = t or "", nxt or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        sets = list(common.shingle_sets([t, e, nxt], 5))
        true = [len(np.intersect1d(sets[0], s)) / max(1, len(np.union1d(sets[0], s))) if len(sets[0]) or len(s) else 1.0 for s in sets[1:]]
        assert abs(got[d].near_edited - true[0]) < 0.25 and abs(got[d].near_next - true[1]) < 0.25
    groups = {d: c for d, _, c in brute(rows, 5, 80)}
    assert {d: x.component_id for d, x in got.items()} == groups and groups[1009] == 0
    assert got[0].fingerprint == got[1009].fingerprint and got[1000].fingerprint == got[1003].fingerprint
    assert minhash.fingerprints(docs_of([])).collect() == []
    alone = minhash.fingerprints(docs_of([(1, "a b c d e f")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


@pytest.mark.parametrize("shared", [0, 50_000])
def test_likeness_of_long_texts_is_near_jaccard(shared):
    r = random.Random(6)
    same = [f"s{r.randrange(10**9)}" for _ in range(shared)]
    texts = [" ".join(same + [f"{c}{r.randrange(10**9)}" for _ in range(100_000 - shared)]) for c in "ab"]
    sets = list(common.shingle_sets(texts, 5))
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    x, y = map(minhash.signature, sets)
    assert abs(minhash.likeness(x, y) - true) < (0.15 if shared else 0.02)
    a, b = minhash.fingerprint(x), minhash.fingerprint(y)
    assert len(a) == 4 * minhash.PERMUTATIONS and np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)]) == minhash.likeness(x, y)


def test_near_duplicates_equal_brute_force(docs_of):
    rows = [(i, t) for i, t in corpus(5) if len((t or "").split()) != 1]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows, 5, 80)
