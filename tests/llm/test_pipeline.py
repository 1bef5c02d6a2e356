"""corpus_pipeline.run against plain Python: each stage on what the one before kept."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from terralume.llm import mixing, packing, pii, toxicity
from terralume.llm.queries import tokenizer_path
from tests.llm.test_llm_joins import brute


def test_run_equals_brute_force(spark, docs_of, tmp_path):
    r = random.Random(7)
    plain = [f"{c}{v}" for c in "bcdfglmnprst" for v in ("and", "ord", "ile", "une", "est")]
    rows = []
    for i in range(150):
        w = [r.choice(plain) for _ in range(r.randrange(8, 40))]
        if i % 5 == 0:
            w[r.randrange(len(w))] = "stupid"
        rows.append((i, " ".join(w), r.choice("ab")))
    rows += [(200 + i, t + (" tail" if i % 2 else ""), s) for i, (_, t, s) in enumerate(rows[::6])]
    rows += [(300, None, "a"), (301, "", None), (302, "mail me a.b@c.org or call +1 (706) 555-3138 soon my good friend", "b"), (302, "mail me a.b@c.org or call +1 (706) 555-3138 soon my good friend", "b"), (None, "a text of its own without any id or group", "a")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    kept = [x for x in rows if scorer.score(x[1] or "") < toxicity.THRESHOLD]
    assert 100 < len(kept) < len(rows) and all("stupid" not in (t or "") for _, t, _ in kept)
    groups, stay = {}, []
    ids = [(i, t) for i, (_, t, _) in enumerate(kept)]  # brute force by row
    for i, n, c in brute(ids, 5, 80):
        if n:
            groups.setdefault(c, []).append(kept[i])
        else:
            stay.append(kept[i])
    assert any(len(g) > 1 for g in groups.values())
    for g in groups.values():
        stay.append(min(g, key=lambda x: (x[0] is None, x[0] or 0)))
    masked = [(d, None if t is None else pii.mask(t), s) for d, t, s in stay]
    assert any(t and "[EMAIL]" in t for _, t, _ in masked)
    copies = Counter()
    for x in mixing.mix(docs_of(masked)).collect():
        copies[x.doc_id] += x.copies
    want = Counter()
    for d, t, _ in masked:
        ids = packing.token_bytes(t or "", tokenizer_path()) + bytes(4)
        assert len(ids) <= 4 * packing.CAPACITY
        want[d, 0, 0, len(ids) // 4, zlib.crc32(ids)] += copies[d]
    assert got == +want


def test_stages_take_no_documents(spark, docs_of, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), str(tmp_path)).collect() == []
