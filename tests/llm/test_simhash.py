import hashlib
import random
import re

import numpy as np
import xxhash

from repolens.llm.simhash_trie import block_masks, distinct_documents, fingerprint, linked_entries, near_duplicates, tries, walk


def slow_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def slow_classes(fps):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        smallest = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (smallest == label).all():
            return label
        label = smallest


def clustered(n, seed, flips):
    random = np.random.default_rng(seed)
    fps = random.choice(random.integers(0, 2**63, max(1, n // 6), dtype=np.uint64), n)
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << random.integers(0, 64, n).astype(np.uint64))
    return np.unique(fps)


def test_walk_matches_all_pairs():
    for seed in range(12):
        fps = clustered(200, seed, seed % 6)
        assert (walk(fps, [(0, len(fps))]) == slow_classes(fps)).all()


def test_every_linked_pair_meets_in_a_trie_of_bounded_size(spark):
    fps = np.unique(np.concatenate([clustered(600, 1, 3), clustered(300, 2, 1)[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    entries = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for size in (10_000, 20):
        placed = {}
        for r in tries(entries, size).collect():
            placed.setdefault(r.trie, set()).add(r.fp)
        together = {(a, b) for members in placed.values() for a in members for b in members if a < b}
        keys = fps.view(np.int64)
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3):
                assert i == j or (min(keys[i], keys[j]), max(keys[i], keys[j])) in together
        links = linked_entries(entries, trie_size=size).collect()
        parent = {int(k): int(k) for k in keys}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links:
            parent[max(top(r.fp), top(r.other))] = min(top(r.fp), top(r.other))
        label = slow_classes(fps)
        classes = {}
        for k, c in zip(keys, label):
            classes.setdefault(c, set()).add(top(int(k)))
        assert all(len(c) == 1 for c in classes.values()) and len(set().union(*classes.values())) == len(classes)
    for paths in block_masks(3):
        assert all(matched ^ left == (1 << 64) - 1 for matched, left in paths)


def test_documents(spark, odd_docs, no_docs):
    random.seed(2)
    base = [" ".join(random.choice("abcdefgh") * random.randint(1, 4) for _ in range(300)) for _ in range(12)]
    texts = base + [b + " tail" for b in base] + base[:3] + ["", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text").where("doc_id IS NULL OR doc_id < 0"))
    rows = docs.collect()
    fps = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(rows))
    while (smallest := np.where(near, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = smallest
    want = []
    for r, f, c in zip(rows, fps, label):
        members = [x.doc_id for x, y in zip(rows, label) if y == c and x.doc_id is not None]
        want.append((r.doc_id, f"{int(f):016x}", min(members, default=None)))
    got = near_duplicates(docs).collect()
    assert sorted(map(repr, [(r.doc_id, r.fingerprint, r.component_id) for r in got])) == sorted(map(repr, want))
    assert near_duplicates(odd_docs).count() == odd_docs.count() and near_duplicates(no_docs).count() == 0


def test_long_text():
    text = "Wörter Und mehr Words " * 4000
    assert fingerprint(text) == slow_fingerprint(text)


def test_one_row_of_each_class_whatever_its_id(spark):
    words = [f"{a}{b}{c}" for a in "pqrstuv" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(random.Random(i).choices(words, k=40)) for i in range(6)]
    rows = [
        (None, texts[0], "a"), (None, texts[1], "b"), (None, texts[2], "c"), (None, texts[2].upper(), "d"),
        (4, texts[3], "e"), (4, texts[4], "f"), (4, texts[4] + " ", "g"), (4, texts[4] + " ", "g"),
        (9, texts[5], "h"), (2, texts[5].title(), "i"),
    ]
    kept = [tuple(r) for r in distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()]
    third = min(rows[2:4], key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())
    assert sorted(map(repr, kept)) == sorted(map(repr, [rows[0], rows[1], third, rows[4], rows[6], rows[9]]))


def test_larger_budgets_lose_no_pair(spark):
    for budget in range(4, 9):
        bases = clustered(120, budget, 1)
        # errors spread over all bits, so that the pair agrees on none of four blocks
        spread = sum(1 << (i * 64 // budget) for i in range(budget))
        fps = np.unique(np.concatenate([bases, bases[:40] ^ np.uint64(spread), clustered(200, budget + 10, budget // 2)]))
        keys = fps.view(np.int64)
        entries = spark.createDataFrame([(int(x),) for x in keys], "fp long")
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= budget
        label = np.arange(len(fps))
        while (smallest := np.where(near, label[None, :], len(fps)).min(axis=1)).tolist() != label.tolist():
            label = smallest
        place = {int(k): i for i, k in enumerate(keys)}
        got = np.arange(len(fps))
        for r in linked_entries(entries, budget, trie_size=10_000 if budget % 2 else 60).collect():
            a, b = got[place[r.fp]], got[place[r.other]]
            got[got == max(a, b)] = min(a, b)
        assert (got == label).all(), budget
        assert (label != np.arange(len(fps))).sum() > 40


def test_resembling_rows_go_and_others_stay(spark):
    import random

    from repolens.llm.simhash_trie import distinct_resembling, shingles

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, near = [], []
    for g in range(30):
        base = [word() for _ in range(300)]
        rows.append((10 * g, " ".join(base)))
        for k in (1, 2):
            copy = list(base)
            for at in rng.sample(range(0, 300, 6), 3 * k):
                copy[at] = word()
            rows.append((10 * g + k, " ".join(copy)))
            near.append((10 * g, 10 * g + k))
    rows += [(1000 + i, "popular start " * 40 + f"end {i}") for i in range(40)] + [(None, "null id"), (None, None), (2000, ""), (7, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, first string, class int")
    kept = [(r.doc_id, r.text) for r in distinct_resembling(docs).collect()]
    sets = [(r, shingles(r[1], 5)) for r in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    stay = [s for r, s in sets if r in kept]
    assert len(kept) == len(set(kept)) and all(any(alike(s, k) for k in stay) for r, s in sets if r not in kept)
    ids = {i for i, _ in kept}
    pairs = [(a, b) for a, b in near if alike(dict((r[0], s) for r, s in sets)[a], dict((r[0], s) for r, s in sets)[b])]
    assert sum(b not in ids for _, b in pairs) >= 0.8 * len(pairs) > 0
    assert distinct_resembling(docs.limit(0)).count() == 0


def test_no_row_of_a_large_class_stays_beside_one_it_resembles(spark):
    import random

    from repolens.llm.simhash_trie import distinct_resembling, shingles

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    # one repeated word decides the fingerprint: all rows are one class of 25 unlike texts with four versions each
    bases = [[word() for _ in range(40)] for _ in range(25)]
    versions = [[(100 * k + g, " ".join(["again"] * 200 + base[: 40 - 2 * k] + [word() for _ in range(2 * k)])) for g, base in enumerate(bases)] for k in range(4)]
    crowd = [(7000 + i, " ".join(["again"] * 200 + bases[20][:39] + [word()])) for i in range(120)]  # more than its pairs are worth checking
    rows = sum(versions, []) + crowd + [(5000 + i, None if i % 2 else "") for i in range(5)] + [(6000, versions[0][9][1]), (None, versions[0][11][1])]
    sets, kept = {}, []
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        sets[row] = own = shingles(row[1], 5)
        if not any(len(own & sets[k]) >= 0.8 * len(own | sets[k]) for k in kept):
            kept.append(row)
    assert len({r[0] for r in kept if r[0] is not None and r[0] < 100}) == 25 < len(kept) < 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (4, 0):
        got = [(r.doc_id, r.text) for r in distinct_resembling(docs, rounds=rounds).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, kept)), rounds


def test_unlike_rows_of_a_large_class_list_few_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from repolens.llm.simhash_trie import near_pairs, rare_tokens, settled, shingles

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows, sets = [word() for _ in range(150)], [], []
    # versions of one text, most of them too far from each other; a few near ones and short ones
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(150), rng.choice((5, 6)) if i % 15 else 1):
            text[at] = word()
        rows.append((i, " ".join(text[: 150 if i % 20 != 7 else 126])))
    rows += [(300 + i, " ".join(word() for _ in range(8)) if i % 2 else "") for i in range(6)]
    docs = spark.createDataFrame(rows, "id long, text string")
    left = docs.select(F.lit(1).alias("class"), F.struct(
        F.lit(False).alias("no_id"), F.col("id").alias("doc_id"), (-F.length("text")).alias("order"), F.sha2("text", 256).alias("digest")).alias("first"), "text")
    kept, texts = [], set()
    for i, text in rows:
        own = shingles(text, 5)
        if text not in texts and not any(len(own & k) >= 0.8 * len(own | k) for k in sets):
            kept.append(i)
            sets.append(own)
        texts.add(text)
    got = sorted(r.first.doc_id for r in settled(left, 5, 0.8).collect())
    assert got == kept and 150 < len(kept) < 300
    met = rare_tokens(docs.withColumnRenamed("id", "row").withColumn("class", F.lit(1)), 5, 0.8)
    assert near_pairs(met, 0.8).count() < 20 * len(rows)
