import random
import zlib

import numpy as np
import pytest

from repolens.llm.common import new_path
from repolens.llm.elias_fano import BLOCK, EliasFano, read_documents, token_id_files, write_ids
from repolens.llm.packing import pack
from repolens.llm.tokens import PieceEncoder

pub = pytest.importorskip("public_tokenizers")
FORMATS = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "é", "1", "23", "'s", "'", "...", "<|endoftext|>", "<|", "\xa0", "\x1c", " ", "日本", "😀", "İ", "ß", "Σ", "\x00", "_", "word", "Word."]


def reference(name, texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(pub.path(name))
    tool.encode_special_tokens = True
    return [e.ids for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,spaces", FORMATS)
def test_pieces_give_the_ids_of_the_whole_text(name, spaces, monkeypatch):
    import repolens.llm.tokens as tokens

    random.seed(3)
    texts = [None, ""] + ["".join(random.choice(PARTS) for _ in range(random.randint(0, 15))) for _ in range(2000)]
    texts += ["the quick brown fox. Jumps, over!! " * 300, "x" * 5000]
    want = reference(name, texts)
    for bound in (1_000_000, 50):  # with a tiny cache pieces are dropped again and again
        monkeypatch.setattr(tokens, "CACHED_PIECES", bound)
        tool = PieceEncoder(pub.path(name), spaces)
        got = [x.tolist() for a in range(0, len(texts), 64) for x in tool.encode(texts[a : a + 64])]
        assert got == want


def test_elias_fano_select_and_values():
    random.seed(5)
    for n, top in [(0, 0), (1, 0), (1, 10**6), (2, 3), (500, 500), (700, 10**7), (65, 0)]:
        values = np.array(sorted(random.randint(0, top) for _ in range(n)), np.int64)
        code = EliasFano.of(values)
        assert code.values().tolist() == values.tolist()
        assert [code.select(i) for i in range(n)] == values.tolist()
        bits = 8 * (len(code.low) + len(code.high)) + 32 * len(code.samples)
        assert n < 100 or bits <= n * (3 + max(0, np.log2(max(top, 1) / n))) + 64 < 64 * n


def expected_start(docs, name, end_id):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = reference(name, [r.text for r in rows])
    out, at = {}, 0
    for r, found in zip(rows, ids):
        found = [*found, end_id]
        out.setdefault(r.doc_id, []).append((len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    return out, at


def test_files_hold_the_documents_in_order(odd_docs, no_docs, monkeypatch, spark):
    import repolens.llm.elias_fano as module

    monkeypatch.setattr(module, "BLOCK_IDS", 200)
    rows = token_id_files(odd_docs, pub.path("word_bpe_49k.json")).collect()
    want, total = expected_start(odd_docs, "word_bpe_49k.json", 2)
    rows.sort(key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert at == total
    for key, sizes in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in rows if r.doc_id == key) == sorted(sizes)
    assert token_id_files(no_docs, pub.path("word_bpe_49k.json")).count() == 0
    path = new_path(spark, "ids-test")
    write_ids(odd_docs, path, pub.path("word_bpe_49k.json"), False, 2)
    blocks = spark.read.schema(BLOCK).parquet(path)
    assert blocks.count() > 1 and blocks.agg({"n_ids": "sum"}).first()[0] == total
    assert read_documents(spark, path).count() == len(rows)


def test_packing_loses_nothing(odd_docs, no_docs):
    rows = pack(odd_docs, pub.path("byte_bpe_50k.json"), 64).collect()
    want, total = expected_start(odd_docs, "byte_bpe_50k.json", 1)
    by_sequence = {}
    for r in rows:
        assert len(r.ids) == r.length * r.width and zlib.crc32(np.frombuffer(r.ids, f"<u{r.width}").astype("<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for number, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or number == max(by_sequence)
    assert sorted(by_sequence) == list(range(-(-total // 64)))
    whole = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        whole.setdefault(r.doc_id, []).append(r)
    for key, pieces in whole.items():
        assert sum(p.length for p in pieces) == sum(n for n, _ in want[key])
        if len(want[key]) == 1:
            ids = np.concatenate([np.frombuffer(p.ids, f"<u{p.width}").astype("<u4") for p in pieces])
            assert (len(ids), zlib.crc32(ids.tobytes())) == want[key][0] and [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
    assert pack(no_docs, pub.path("byte_bpe_50k.json")).count() == 0


def test_lines_and_latin_cases_are_no_pieces_of_their_own():
    import public_tokenizers

    tool = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = ["one end.\nNext Wörter\n\nÉcole it\n's", "next école END. wörter 's", "\nİx\nΣΑΣ ŕ\n", "\n"]
    want = [tool.plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tool.encode(texts[:2])] == want[:2]
    assert not any("\n" in p or p != p.lower() for p in tool.index) and len(tool.index) < 12
    assert [x.tolist() for x in tool.encode(texts)] == want
    spaced = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    assert [x.tolist() for x in spaced.encode(texts)] == [spaced.plain.encode(t, add_special_tokens=False).ids for t in texts]
