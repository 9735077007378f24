"""Word search against brute force, with rare and frequent words, wide symbols and long searches."""

import random

from repolens.operators import search


def test_best_symbols_equal_brute_force(spark):
    rng = random.Random(3)
    often = [f"w{i}" for i in range(9)]
    texts = {}
    for i in range(400):
        words = rng.choices(often[:5], k=rng.randrange(1, 5)) if i % 10 else rng.sample(often, 9)
        texts[f"{i:03d}"] = " ".join([*words, f"only{i}"])
    symbols = spark.createDataFrame([("r", f"n{k}", f"s{k}", v) for k, v in texts.items()], "repo_hash string, qualified_name string, symbol_id string, signature string")
    asked = [" ".join(rng.sample(often, rng.randrange(1, 4)) + rng.choices([f"only{rng.randrange(400)}", "gone", "w0"], k=1)) for _ in range(60)] + [" ".join(often), "gone", ""]
    searches = spark.createDataFrame([(i, "r", a) for i, a in enumerate(asked)], "query_id long, repo_hash string, search string")
    limit = 7
    want = set()
    for i, text in enumerate(asked):
        terms = set(text.split())
        score = sorted((-sum(w in terms for w in [f"n{k}", *v.split()]), f"s{k}") for k, v in texts.items())
        want |= {(i, s, -n, r) for r, (n, s) in enumerate([x for x in score if x[0]][:limit], 1)}
    got = search.text_search(searches, symbols, limit)
    assert {(r.query_id, r.symbol_id, r.hits, r.rank) for r in got.collect()} == want
