import os
from collections import Counter

import pytest

import corpus_pipeline
from repolens.llm import mixing, simhash_trie, toxicity
from repolens.llm.common import stored, table
from tests.llm.test_exact_dedup import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


def test_stages_against_brute_force(spark):
    pytest.importorskip("public_tokenizers")
    docs = table(spark, SF, "documents")
    # repeated and odd rows go through all stages
    odd = spark.createDataFrame([(-5, None, None, None, None), (-4, "twice", "en", "src1", 5), (-4, "twice", "en", "src1", 5), (None, "no id", "en", "src1", 5)], docs.schema)
    before = stored(docs.unionByName(odd), "pipeline-test")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        results.append(before := stored(stage(spark, before, SF), name))
        if name != "packing":
            assert before.columns == docs.columns
    source = stored(docs.unionByName(odd), "pipeline-source").collect()
    clean, exact, near, mixed = ([tuple(r) for r in x.collect()] for x in results[:4])
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, SF, "labels")))
    scores = toxicity.Scorer(*model.tables()).scores([r.text for r in source])
    assert Counter(clean) == Counter(tuple(r) for r, s in zip(source, scores) if s < 0.5)

    def groups(rows, key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r)
        return out.values()

    smallest = lambda r: (r[0] is None, r[0] or 0)
    best = [min(g, key=lambda r: (-len(r[1] or ""), *smallest(r))) for g in groups(clean, lambda r: plain(r[1]))]
    assert Counter(r[0] for r in exact) == Counter(r[0] for r in best)
    # a row goes only if one that stays resembles it, and none that resembles another is within reach of it unseen
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = {r[0]: simhash_trie.shingles(r[1], 5) for r in exact}
    stay = {r[0] for r in near}
    assert Counter(near) == Counter(r for r in exact if r[0] in stay) and stay <= set(sets)
    assert all(any(alike(sets[g], sets[k]) for k in stay) for g in set(sets) - stay)
    copies = {r.doc_id: r.copies for r in mixing.mix(results[2]).collect()}
    assert Counter(r[0] for r in mixed) == Counter({k: n for k, n in copies.items() if n})
    pieces = results[4].collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in mixed}
    assert sum(p.length for p in pieces if p.start == 0) <= sum(p.doc_tokens for p in pieces)
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    assert sorted(used) == list(range(len(used))) and all(n == 2048 for s, n in used.items() if s < len(used) - 1)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_table_passes_all_stages(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0
