import hashlib
import random

from repolens.llm.quartile_digest import codes, edited, fingerprint_documents, likeness, parsed, printed


def expected(rows):
    """doc_id -> rows of (n_chars, sha, next text) in the stated order."""
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    out = []
    for i, r in enumerate(order):
        following = order[(i + 1) % len(order)].text or ""
        other = edited(r.text or "", following)
        out.append((r.doc_id, len(r.text or ""), hashlib.sha256(other.encode()).hexdigest(), printed(codes(r.text or "")), printed(codes(other)),
                    likeness(printed(codes(r.text or "")), printed(codes(other))), likeness(printed(codes(r.text or "")), printed(codes(following)))))
    return out


def test_matches_brute_force(spark, odd_docs, no_docs):
    random.seed(4)
    many = spark.createDataFrame([(i, "".join(random.choice("abc déf") for _ in range(random.randint(0, 400)))) for i in range(150)], "doc_id long, text string")
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "xyz xyz xyz")], "doc_id long, text string")
    for table in (many.repartition(5), odd_docs, nulls, many.limit(1)):
        got = fingerprint_documents(table).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(table.collect())))
    assert fingerprint_documents(no_docs).count() == 0


def test_likeness_tells_edited_from_other_texts():
    random.seed(1)
    words = ["".join(random.choice("aeioutnrsl") for _ in range(random.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(random.choice(words) for _ in range(400)) for _ in range(60)]
    for a, b in zip(texts, texts[1:]):
        mine, changed, other = (printed(codes(t)) for t in (a, edited(a, b), b))
        assert likeness(mine, mine) == 1.0 and likeness(mine, changed) > likeness(mine, other)
        assert 0 <= likeness(mine, other) == likeness(other, mine) <= 1
        assert (parsed(mine) == codes(a)).all()
    assert printed(codes("")) != printed(codes("ab")) and likeness(printed(codes("")), printed(codes(""))) == 1.0
