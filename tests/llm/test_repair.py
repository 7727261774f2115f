import hashlib
import itertools
import random
import re
import zlib

import pytest

from folioforge.llm import queries, repair
from folioforge.tables import table

GOOD = re.compile(r"(s?(ua)+)?")


def lettered(turns):
    """Signature and faults of (role, text) turns in order, by the plain rules."""
    seen, faults, letters = set(), [], ""
    for role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
    return letters, faults


def every_edit(letters, most):
    """(cost, audit) of all edits of at most ``most`` inserts that give a good conversation, by trying all."""
    best = None
    options = [("D",) if c == "x" else ("K", "Ru", "Ra", "D") for c in letters]
    for choice in itertools.product(*options):
        for gaps in itertools.product(range(most + 1), repeat=len(letters) + 1):
            if sum(gaps) > most:
                continue
            for inserted in itertools.product("ua", repeat=sum(gaps)):
                made, audit, cost, at = "", "", 0, 0
                for i in range(len(letters) + 1):
                    for _ in range(gaps[i]):
                        made, audit, cost, at = made + inserted[at], audit + "I", cost + 2, at + 1
                    if i < len(letters):
                        edit, c = choice[i], letters[i]
                        audit += edit[0]
                        cost += {"K": 0, "R": 2, "D": 3}[edit[0]] + (c.isupper() and edit != "D")
                        made += c.lower() if edit == "K" else edit[1:]
                if GOOD.fullmatch(made) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def replay(audit, turns):
    """Repaired (role, text) turns of an audit."""
    out, i, letters = [], 0, ""
    for edit in audit:
        wanted = "assistant" if letters[-1:] == "u" else "user"
        if edit == "I":
            out.append((wanted, ""))
        else:
            role, text = turns[i]
            i += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else wanted, text))
        letters += out[-1][0][:1]
    assert i == len(turns) and GOOD.fullmatch(letters)
    return out


def plain(rows):
    """conv_id -> all results, from (conv_id, turn, role, text) rows; edits by a shortest path over whole strings."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            role = "user" if fate == 4 else role
            kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [r[1:] for r in kept]
        letters, faults = lettered(turns)
        numbers = {r[0] for r in kept} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [t[0][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(letters)
        text = "\n".join(f"{r}:{t}" for r, t in replay(audit, turns))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def cheapest(letters):
    """Least (cost, audit) by Dijkstra over (turns read, initials made), comparing whole audits."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if (i, made) in done:
            continue
        done.add((i, made))
        if i == len(letters) and made in ("", "a"):
            return cost, audit
        go = []
        wanted = "a" if made == "u" else "u"
        go.append((2, "I", i, wanted))
        if i < len(letters):
            c = letters[i]
            go.append((3, "D", i + 1, made))
            if c != "x":
                if c.lower() == wanted or (c.lower() == "s" and made == ""):
                    go.append((int(c.isupper()), "K", i + 1, c.lower()))
                go.append((2 + c.isupper(), "R", i + 1, wanted))
        for price, edit, j, state in go:
            heapq.heappush(heap, (cost + price, audit + edit, j, state))


def test_least_cost_and_ties_against_all_edits():
    for n in range(4):
        for letters in map("".join, itertools.product("xsuaoSUA", repeat=n)):
            if n == 3 and hash_of(letters) % 6:
                continue
            trie = repair.Trie()
            assert trie.solve(letters) == every_edit(letters, 2 if n == 3 else 4), letters


def hash_of(letters):
    return zlib.crc32(letters.encode())


def test_long_signatures_against_shortest_paths():
    random.seed(2)
    signatures = sorted("".join(random.choice("xsuaoSUAO") for _ in range(random.randint(0, 14))) for _ in range(400))
    trie = repair.Trie()
    for s in signatures:
        assert trie.solve(s) == cheapest(s), s


def test_shared_prefixes_are_computed_once():
    trie = repair.Trie()
    signatures = sorted(["ua" * 500 + x for x in "suaxo"] + ["ua" * 500] * 3)
    for s in signatures:
        trie.solve(s)
    assert trie.steps == 1000 + 5


def results(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()) for r in rows}
    assert len(out) == len(rows)
    return out


def rows_of(n, seed):
    random.seed(seed)
    out = []
    for c in range(n):
        for turn in range(random.randint(1, 12)):
            role = random.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = random.choice(["Well.", "So what?", "cut off", "", " \n", None, "Ends. \x0b\n", "Ünï!", "line\nline."])
            out.append((c if c else None, turn if turn != 3 else random.choice([3, None, 40]), role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_repair_equals_plain_rules(spark, clashing, seed):
    rows = rows_of(80, seed)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    want = plain(rows)
    assert results(repair.damaged_and_repaired(df)) == want
    clash = df.selectExpr("*", "'x' copy", "'x' kind", "'x' _hash", "'x' pos", "'x' cost", "'x' audit", "'x' fate", "'x' signature", "'x' same")
    assert results(repair.damaged_and_repaired(clash)) == want


def test_empty_dropped_and_repeated(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert repair.damaged_and_repaired(spark.createDataFrame([], schema)).count() == 0
    gone = [(c, t, "user", "Hi.") for c in range(300) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = results(repair.damaged_and_repaired(spark.createDataFrame(gone, schema)))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone} and got
    rows = [(9, 0, "user", "Hi."), (9, 0, "user", "Hi."), (9, 1, "assistant", "Yes.")]
    assert results(repair.damaged_and_repaired(spark.createDataFrame(rows, schema))) == plain(rows)


def test_turns_of_one_number_have_an_order(spark):
    rows = [(1, 5, "user", "b."), (1, 5, "assistant", "a."), (1, 5, "user", "c."), (1, 6, "assistant", "d.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    first = results(repair.repair(df.repartition(4)))
    assert first == results(repair.repair(df.orderBy("text"))) and first[1][3] == 0


def test_a_very_long_conversation_and_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}.") for i in range(20_000)] + [(2, 0, "user", "word " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = results(repair.repair(df))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 20_000)
    assert got[1][7] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:-1]).encode()).hexdigest()
    assert got[2][3:7] == (1, 0, 3, "D") or got[2][6] in ("D", "KI")


def test_query_equals_plain_rules(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.op12_conversation_repair(spark, sf)) == plain(rows)
