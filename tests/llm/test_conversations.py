import hashlib
import random
import zlib
from itertools import product

from talus.llm.conversations import END, START, SOUND, TRUNCATED, BLANK, DUPLICATE, costs_before, path, repaired
from talus.llm.op13 import op13_conversation_repair

COLUMNS = "conv_id long, turn long, role string, text string"


def accepts(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return (rest or roles == "") and rest == "ua" * (len(rest) // 2) if roles else True


def brute(rows):
    """(cost, labels) over all edits of up to three rows, with up to two insertions in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    ways = []
    for fault, initial in rows:
        more = 5 if fault == TRUNCATED else 0
        ways.append([("D", 2, "")] + ([] if fault in (BLANK, DUPLICATE) else [("K", more, initial), ("R", 1 + more, "u"), ("R", 1 + more, "a")]))
    best = None
    for inserted in product(gaps, repeat=len(rows) + 1):
        for picked in product(*ways):
            out, labels, cost = inserted[0], "I" * len(inserted[0]), 5 * len(inserted[0])
            for (label, c, written), gap in zip(picked, inserted[1:]):
                out, labels, cost = out + written + gap, labels + label + "I" * len(gap), cost + c + 5 * len(gap)
            if accepts(out) and (best is None or (cost, labels) < best):
                best = (cost, labels)
    return best


def test_least_path_equals_listing_all_edits():
    r = random.Random(3)
    for n in (1, 2, 3):
        for _ in range(40 if n < 3 else 12):
            rows = [(r.choice([SOUND, SOUND, BLANK, DUPLICATE, TRUNCATED]), r.choice("suaux")) for _ in range(n)]
            assert (costs_before(rows, END)[0][START], path(rows, END, START, True)[0]) == brute(rows)


def plain(rows):
    """One conversation by textbook: (role, text) of its rows in order, costs with whole label strings."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    name = {"u": "user", "a": "assistant"}

    def inserts(value):
        for _ in range(3):
            for q in range(4):
                for c in set("ua") & set(moves[q]):
                    if (w := value[moves[q][c]]) is not None:
                        value[q] = min(x for x in (value[q], (w[0] + 5, "I" + w[1], (name[c] + ":", *w[2]))) if x is not None)
        return value

    value = inserts([(0, "", ()), None, None, (0, "", ())])
    for (role, text), fault in reversed(list(zip(rows, faults))):
        more, now = 5 if fault == "t" else 0, []
        for q in range(4):
            ways = [(value[q][0] + 2, "D" + value[q][1], value[q][2])]
            if fault not in ("b", "d"):
                for c, q2 in moves[q].items():
                    w = value[q2]
                    if role[:1] == c:
                        ways.append((w[0] + more, "K" + w[1], (f"{role}:{text}", *w[2])))
                    if c in name:
                        ways.append((w[0] + 1 + more, "R" + w[1], (f"{name[c]}:{text}", *w[2])))
            now.append(min(ways))
        value = inserts(now)
    pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return *[faults.count(x) for x in "bdt"], pairs, value[0][0], value[0][1], "\n".join(value[0][2])


def some_rows(seed, conversations, most):
    r = random.Random(seed)
    return [
        (conv, r.choice([None, *range(most)]) if r.random() < 0.1 else turn, r.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), r.choice(["Yes.", "No?", "so", "", " \n", None, f"Line {turn}."]))
        for conv in conversations
        for turn in range(r.randint(1, most))
    ]


def held(rows):
    """What ``repaired`` has to give for rows of the columns, by conversation."""
    out = {}
    for conv in {c for c, *_ in rows}:
        mine = sorted((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv)
        turns = [t for known, t, *_ in mine if known]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *plain([(r, x) for *_, r, x in mine]))
    return out


def got(df):
    return {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired or "") for x in df.collect()}


def test_repair_equals_brute_force_with_nulls_ties_and_repeated_rows(spark):
    rows = some_rows(1, [None, *range(12)], 9)
    rows += rows[:7]
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(repaired(df)) == held(rows)


def test_long_conversations_are_repaired_in_segments(spark):
    rows = some_rows(2, [1, 2, 3], 120) + [(7, i, "user" if i % 3 else "assistant", f"{i % 50}.") for i in range(300)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert got(repaired(df, segment_rows=7)) == held(rows)


def test_clashing_names_very_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "a" * 300_000 + "."), (1, 1, "assistant", "b " * 200_000)]
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], COLUMNS + ", id long, fault string, said string")
    assert got(repaired(df)) == held(rows)
    assert repaired(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query_damages_by_rule(spark, tmp_path):
    rows = [r for r in some_rows(5, [*range(60), None], 6)] + [(900 + i, 0, "user", "Only.") for i in range(60)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "conversations.parquet"))
    hurt = []
    for c, t, r, x in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if draw == 1 else "".join(ch for ch in x if ch not in ".!?") if draw == 2 else x
        hurt += [(c, t, "user" if draw == 4 else r, x)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", "") for c, *_ in rows} | held(hurt)
    assert any(v == (0, 0, 0, 0, 0, 0, "", "") for v in want.values())
    found = op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: (*v[:7], hashlib.sha256(v[7].encode()).hexdigest()) for c, v in want.items()}
