import hashlib
import random
import zlib

from repolens.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, pos string, audit int, fault long"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(codes):
    """Forward search over all edits: best (cost, letters) per state."""
    def close(best):
        for _ in range(3):
            for state, (cost, letters) in list(best.items()):
                for more, letter, _, to in tr.ARCS[""][state]:
                    best[to] = min(best.get(to, (cost + more, letters + letter)), (cost + more, letters + letter))
        return best

    best = close({tr.NOTHING: (0, "")})
    for code in codes:
        after = {}
        for state, (cost, letters) in best.items():
            for more, letter, read, to in tr.ARCS[code][state]:
                if read:
                    after[to] = min(after.get(to, (cost + more, letters + letter)), (cost + more, letters + letter))
        best = close(after)
    return min(best[s] for s in tr.ENDS if s in best)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [] if d == 0 else [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def report(rows, ids):
    out = {}
    for conv in ids:
        talk = sorted([r[1:] for r in rows if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in talk if t is not None]
        seen, faults, codes = set(), [], ""
        for _, role, text in talk:
            said = text.strip(SPACE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest(codes)
        lines, at, last = [], 0, ""
        for letter in audit:
            role, text = talk[at][1:] if letter != "I" else (None, "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def rows_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_auction_gives_the_cheapest_and_least_audit():
    rng = random.Random(4)
    for _ in range(4000):
        codes = "".join(rng.choice("xsuaoSUAOuauaua") for _ in range(rng.randint(0, 10)))
        assert tr.repair_plan(codes) == cheapest(codes), codes


def test_prices_are_dual_feasible_and_tight_on_the_way():
    codes = "sUxaauoSxuuA"
    price = tr.converged_prices(codes)
    for row in range(len(codes) + 1):
        for state in range(4):
            for cost, _, read, to in tr.ARCS[codes[row : row + 1]][state]:
                assert price[4 * row + state] <= cost + price[4 * (row + read) + to]
    assert price[tr.NOTHING] == cheapest(codes)[0]


def test_a_long_conversation_takes_linear_time():
    cost, audit = tr.repair_plan("uauSxu" * 20_000)
    assert cost > 0 and len(audit.replace("I", "")) == 120_000


def test_report_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["yes.", "no", "why?", "", " \t", "stop!", "ends here. ", "größe İ.", "two\nlines.", None]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, 7, None]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "User", "agent"]), rng.choice(words)) for _ in range(120)]
    rows += [(20, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)] + [(21, 0, "user", "long " * 50_000 + ".")]
    rows += [(22, -(1 << 63), "user", "a."), (22, (1 << 63) - 1, "assistant", "b."), (23, 4, "user", "same."), (23, 4, "user", "same."), (24, None, None, None)]
    rows += [(c, 0, "user", "Only row.") for c in range(100, 160)]  # some are dropped whole
    turns = frame(spark, rows)
    broken = damage(rows)
    got = rows_of(tr.repair_report(tr.damaged(turns), turns))
    want = report(broken, {r[0] for r in rows})
    want[22] = (min(want[22][0], (1 << 63) - 1), *want[22][1:])
    assert got == want
    assert any(w[6] == "" and w[5] == 0 for w in want.values())


def test_repaired_rows_follow_the_pattern(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "tool", "c"), (1, 3, "assistant", "d."), (2, 0, "system", "s."), (2, 1, "assistant", "x.")]
    placed = tr.placed(frame(spark, rows))
    plans = tr.repair_plans(placed)
    out = tr.repaired(placed, plans).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in out if r.conv_id == 2] == [(2, "R", "user", "s."), (2, "K", "assistant", "x.")]
    assert {r.conv_id: r.audit for r in plans.collect()} == {1: cheapest("uuOa")[1], 2: cheapest("sa")[1]}


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    assert tr.repair_report(tr.damaged(none), none).count() == 0
