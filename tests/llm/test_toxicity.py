import random
import zlib

import numpy as np

from repolens.llm.toxicity import MAX_ROWS, Scorer, clean_documents, features, labelled_rows, letters, toxicity, train

BAD = ["idiot", "moron", "worthless", "disgusting", "pathetic"]


def corpus(n, seed=0):
    pick = random.Random(seed)
    syllables = ["ta", "ren", "lo", "vin", "sha", "mer", "ko", "del", "pu", "gra"]
    rows = []
    for i in range(n):
        words = ["".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(30, 150))]
        bad = i % 6 == 0
        for _ in range(max(2, len(words) // 25) if bad else 0):
            words.insert(pick.randrange(len(words)), pick.choice(BAD))
        # one label in twenty is wrong
        rows.append((i, " ".join(words), int(bad or i % 20 == 1)))
    return rows


def test_learns_words_and_their_misspellings_in_spite_of_wrong_labels(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)
    held = [i for i in got if got[i].held_out]
    right = [got[i].predicted == (i % 6 == 0) for i in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    tool = Scorer(*train([(t, y) for _, t, y in rows]).tables())
    clean = rows[2][1]
    scores = tool.scores([clean, clean + " idiiot m0ron wortless disgustingg", None, "", "??? !!!"])
    assert scores[0] < 0.5 < scores[1] and scores[2] == scores[3] == scores[4]
    assert letters("(M0RON!!)") == "moron"
    ids, owners = features(["moron", "morron", "a", "Moron".lower()])
    assert ids[owners == 0].tolist() == ids[owners == 1].tolist() == ids[owners == 3].tolist() and (owners == 2).sum() == 1


def test_training_rows_are_bounded_and_never_held_out(spark, odd_docs):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic").unionByName(
        spark.createDataFrame([(None, 1), (999, 1), (5, None), (5, 1)], "doc_id long, toxic int"))
    rows = labelled_rows(docs, labels)
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)) <= MAX_ROWS
    assert len(labelled_rows(docs, labels, max_rows=10)) == 10


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity(odd_docs, odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity(no_docs, no_docs, labels.limit(0)).count() == 0
    kept = clean_documents(odd_docs, train([]))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
