import re

from repolens.llm.mixing import mix, mixed_documents


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight again and again, holding what is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**held, **share}
        held.update({s: most * sizes[s] for s in over})


def test_targets_match_repeated_sharing(spark, odd_docs):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 7) * (40 if i % 11 == 0 else 1), f"s{(i * i) % 8}" if i % 5 else None) for i in range(400)], "doc_id long, text string, source string")
    for table in (docs, odd_docs):
        rows = mix(table).collect()
        sizes = {}
        for r in table.collect():
            sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            rate = r.target / r.source_size if r.source_size else 0
            assert int(rate) <= r.copies <= int(rate) + 1 and r.copies <= 3
        assert len(rows) == table.count()


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text", "concat('s', IF(id % 3 = 0, 0, id % 7)) AS source")
    taken = lambda: {r[0]: (r[1], r[2]) for r in mix(docs).groupBy("source").agg({"target": "max", "size": "sum"}).collect()}
    rows = mix(docs).selectExpr("source", "target", "size * copies AS taken").groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    for source, a, b in [(r["source"], r["max(target)"], r["sum(taken)"]) for r in rows]:
        assert abs(a - b) < 0.05 * a, source
    assert taken() == taken()
    assert sorted(mix(docs).select("doc_id", "copies").collect()) == sorted(mix(docs.repartition(7)).select("doc_id", "copies").collect())


def test_mixed_rows_keep_columns(odd_docs, no_docs):
    mixed = mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == mix(odd_docs).agg({"copies": "sum"}).first()[0]
    assert mixed.where("size <> 1 OR target <> 2").isEmpty()
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
