import hashlib

from repolens.llm.exact_dedup import DigestIndex, distinct_documents, exact_duplicates


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_matches_brute_force(odd_docs):
    rows = odd_docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(plain(r.text), []).append(r)
    want = []
    for text, members in groups.items():
        best = max(members, key=lambda r: (len(r.text or ""), r.doc_id is not None, -(r.doc_id or 0)))
        want += [(r.doc_id, best.doc_id, len(members), r.doc_id == best.doc_id, hashlib.sha256(text.encode()).hexdigest()) for r in members]
    got = [tuple(r) for r in exact_duplicates(odd_docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_index_remembers_earlier_batches(spark, odd_docs):
    index = DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(100, "Hello World"), (101, "new one")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in exact_duplicates(first, index).collect()} == {100: True, 101: True}
    again = {r.doc_id: r.keep_id for r in exact_duplicates(odd_docs.where("doc_id IN (3, 5, 9, 6)"), index).collect()}
    assert again == {3: 100, 5: 100, 9: 100, 6: 6}
    assert index.rows().count() == 3
    # another session part opens the same folder
    assert DigestIndex(spark, index.path, buckets=3).rows().count() == 3


def test_distinct_documents_keep_columns_and_one_row_each(odd_docs, no_docs):
    kept = distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(-99 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-99, -2, 4, 5, 6, 7, 11, 12, 13]
    texts = [plain(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts))
    assert distinct_documents(no_docs).count() == 0


def test_hot_digest_is_dealt_over_tasks(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 < 2, 'same text', concat('text ', id)) AS text")
    got = exact_duplicates(docs)
    assert got.where("kept").count() == 1 + docs.where("text <> 'same text'").count()
    assert got.where("NOT kept").selectExpr("max(keep_id)", "min(keep_id)", "max(group_size)").first() == (0, 0, docs.where("text = 'same text'").count())


def test_rows_with_null_or_shared_ids_all_stay(spark):
    schema = "doc_id long, text string, note string"
    rows = [
        (None, "first", "a"), (None, "second one", "b"), (None, "third", "c"), (None, "third", "c"),  # null ids, one repeated
        (8, "short", "a"), (8, "a longer text", "b"), (8, "a longertext", "c"),  # one id, two texts and a copy
        (5, "kept  A", "a"), (5, "a copy that is longer than A", "b"), (3, "a copy that is longer than A", "c"),
        (7, "a bc", "a"), (7, "ab c", "b"),  # equal but for the place of a space
    ]
    kept = [tuple(r) for r in distinct_documents(spark.createDataFrame(rows, schema)).collect()]
    want = [rows[i] for i in (0, 1, 2, 4, 5, 7, 9)] + [(7, "ab c", "b")]
    assert sorted(map(repr, kept)) == sorted(map(repr, want))


def test_a_batch_that_comes_again_adds_no_row(spark):
    docs = spark.createDataFrame([(1, "one"), (None, "two"), (2, "three")], "doc_id long, text string")
    index = DigestIndex(spark, buckets=2)
    assert distinct_documents(docs, index).count() == 3
    more = docs.unionByName(spark.createDataFrame([(None, "four")], docs.schema))
    assert [tuple(r) for r in distinct_documents(more, index).collect()] == [(None, "four")]


def test_clashing_columns_and_the_smallest_long(spark):
    low = -(1 << 63)
    schema = "doc_id long, text string, _id string, _length int, _n int, _key string, digest int, n_chars long, row string, chosen_id int"
    rows = [(low, "same text", "a", 9, 1, "k", 1, 2, "r", 3), (4, "sametext ", "b", 7, 2, "k", 1, 2, "r", 3), (4, "other", "c", 5, 3, "k", 1, 2, "r", 3), (4, "other", "d", 6, 3, "k", 1, 2, "r", 3)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(tuple(r) for r in distinct_documents(docs).collect()) == sorted([rows[0], rows[3]])
    assert {(r.doc_id, r.keep_id) for r in exact_duplicates(docs).collect()} == {(low, low), (4, low), (4, 4)}
