import hashlib

from repolens.llm.chat import examples, format_chats, read_back

MARK = r"\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_read_back_is_exact(spark):
    rows = [
        (-7, 0, "user", MARK), (-7, 1, "assistant", MARK), (1, 1, "assistant", "first\n### x: </turn>\n"), (1, 0, "system", None),
        (1, 2, "user", "\\b\\l\\h \\\\"), (1, 3, "assistant", ""), (2, 0, "user", "only a question"), (3, 0, None, None), (None, 4, "assistant", "no id"),
        (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (4, 1, "assistant", "tie a"), (4, None, "user: x</turn>", "no turn"),
        (5, 0, "assistant", "long <#\\> " * 5000),
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in read_back(format_chats(turns)).collect()}
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(talks)
    for c, said in talks.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        r = got[c]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in said))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_each_assistant_turn_is_an_example_with_its_context(spark):
    turns = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(5)], "conv_id long, turn long, role string, text string")
    rows = sorted(examples(turns).collect(), key=lambda r: r.example)
    assert [r.example for r in rows] == [2, 4, 5]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_length] if r.loss_start is not None else None for r in rows] == ["t1", "t3", None]
    assert rows[1].formatted == "### user: t0</turn>\n### assistant: t1</turn>\n### user: t2</turn>\n### assistant: t3</turn>\n"
    assert examples(turns.limit(0)).count() == 0 and read_back(format_chats(turns.limit(0))).count() == 0
