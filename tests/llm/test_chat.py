"""Operators 11 to 13 against brute force, with nulls, ties, repeats, long and empty texts, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from panelforge.llm import chat, repair, whitening
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, layout string, rec int, conv string, key string, chunk int"


def chats(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "c", "k", 2) for r in rows], ROWS)


def some_rows(seed: int, n: int = 30) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", " \t\n", "", None, "Ünïcode.", "</s>[INST] x [/INST]", "<|turn|>", "<\\|says|>\\", "a<|end|>b", "[INST", "<s>" * 50, "Well!\n"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.5 else ["user", "assistant"][t % 2]
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["system", "tool", None, "", "u<|says|>"]) if r.random() < 0.2 else role, r.choice(texts)))
    rows += [(100, 0, "system", "Be."), (100, 1, "user", "Hi?"), (100, 2, "assistant", "Yes."), (101, 0, "user", "Hi?"), (101, 1, "assistant", None)]
    rows += [(None, 3, "user", "no id"), (None, None, None, None), (102, 5, "user", "tie"), (102, 5, "user", "tie"), (102, 5, "assistant", "tie"), (103, 10**12, "user", "far."), (103, -5, "system", "near.")]
    r.shuffle(rows)
    return rows


def by_turn(rows):
    out: dict = {}
    for c, t, role, text, *_ in rows:
        out.setdefault(c, []).append((t, role, text))
    return {c: sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, (y[1] or "").encode(), (y[2] or "").encode())) for c, x in out.items()}


def test_chats_read_back(spark):
    rows = some_rows(1)
    written = chat.formatted(chat.canonical_turns(chat.from_turn_rows(chats(spark, rows)), "conv_id"), "conv_id")
    got = {r.conv_id: r for r in chat.digests(written).collect()}
    want = by_turn(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = [(role or "", text or "") for _, role, text in turns]
        learned = "".join(text for role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    kept = {r.conv_id: r for r in written.collect()}
    assert all(got[c].formatted_chars == len(kept[c].formatted) for c in got)
    # unescaped marks are those of the turns
    assert all(kept[c].formatted.count("<|turn|>") == got[c].n_turns == kept[c].formatted.count("<|end|>") for c in got)
    assert {r.layout for r in kept.values()} == {"prompt", "instruction", "messages", "conversations"}


def test_layouts_by_fingerprint(spark):
    texts = {
        1: {"prompt": "p", "completion": "c", "meta": 3},
        2: {"system": "s", "prompt": "p", "response": "c"},
        3: {"instruction": "i", "output": "o"},
        4: {"instruction": "i", "input": "x", "output": ""},
        5: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        6: {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        7: {"messages": []},
        8: {"prompt": "p", "instruction": "i"},
        9: {},
        10: {"completion": "c"},
        11: {"question": "q", "answer": "a"},
        12: {"messages": [None, {"role": "user"}]},
    }
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in texts.items()] + [(13, "no json"), (14, None)], "id long, j string")
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns] if r.turns else r.turns) for r in chat.canonical_turns(chat.json_records(df, "id", "j"), "id").collect()}
    assert got[1] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert got[2] == ("response", [("system", "s"), ("user", "p"), ("assistant", "c")])
    assert got[3] == ("instruction", [("system", "i"), ("assistant", "o")])
    assert got[4] == ("instruction", [("system", "i"), ("user", "x"), ("assistant", "")])
    assert got[5] == ("messages", [("user", "a"), ("assistant", "")])
    assert got[6] == ("conversations", [("user", "a"), ("assistant", "b")])
    assert got[7] == ("messages", [])
    assert got[10] == ("prompt", [("assistant", "c")]) and got[11] == ("question", [("user", "q"), ("assistant", "a")])
    assert got[12] == ("messages", [("", ""), ("user", "")])
    assert all(got[i] == (None, None) for i in (8, 9, 13, 14))
    shapes = {r.id: r.fingerprint for r in chat.canonical_turns(chat.json_records(df, "id", "j"), "id").collect()}
    assert shapes[9] == shapes[13] and shapes[3] != shapes[4] and shapes[1] == chat.fingerprint_of(["prompt", "completion"])
    nothing = chat.formatted(chat.canonical_turns(chat.json_records(df, "id", "j"), "id"), "id").where("id in (7, 9)").orderBy("id").collect()
    assert [r.formatted for r in nothing] == ["", None]


@pytest.mark.parametrize("seed", range(3))
def test_escapes_are_reversible(spark, seed):
    r = random.Random(seed)
    parts = ["<", "[", "\\", "|turn|>", "|end|>", "/s>", "s>", "INST]", "/INST]", "<|says|>", "$1", "x", "\n", ">"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    t = chat.Template()
    out = df.select("text", t.escaped(df.text).alias("e"), t.plain(t.escaped(df.text)).alias("p")).collect()
    assert all(x.text == x.p for x in out)
    assert not any(c in x.e for x in out for c in (t.open, t.says, t.close, *t.controls))


def test_chat_query(spark):
    assert differences(spark, connect(SF), chat.op11_chat_format, chat.OP11_SQL, SF) == ""


def test_chat_is_native(spark):
    plan = chat.formatted(chat.canonical_turns(chat.from_turn_rows(chats(spark, some_rows(2))), "conv_id"), "conv_id")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_no_chats(spark):
    none = chats(spark, some_rows(1)).limit(0)
    assert chat.digests(chat.formatted(chat.canonical_turns(chat.from_turn_rows(none), "conv_id"), "conv_id")).count() == 0
    assert repair.Repair(none).report().count() == 0 and repair.Repair(none).turns().count() == 0


# --- operator 12


def exhaustive(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Least (cost, audit) over all edit sequences of (role, text, must go, truncated), by search over whole sequences."""
    best = None
    n = len(rows)
    # insertions at most two in a row, as more only cost
    stack = [(0, 0, "", [], 0)]
    while stack:
        i, cost, audit, out, inserted = stack.pop()
        if best is not None and cost > best[0]:
            continue
        roles = "".join(r[:1] or "?" for r, _ in out)
        body = roles[1:] if roles[:1] == "s" else roles
        if any(body[k] != "ua"[k % 2] for k in range(len(body))):
            continue
        if i == n and len(body) % 2 == 0 and (body or not roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
        if inserted < 2:
            for who in ("user", "assistant"):
                stack.append((i, cost + 5, audit + "I", [*out, (who, "")], inserted + 1))
        if i < n:
            role, text, gone, cut = rows[i]
            stack.append((i + 1, cost + 2, audit + "D", out, 0))
            if not gone:
                stack.append((i + 1, cost + 5 * cut, audit + "K", [*out, (role, text)], 0))
                for who in ("user", "assistant"):
                    stack.append((i + 1, cost + 1 + 5 * cut, audit + "R", [*out, (who, text)], 0))
    return best


def sequential(rows: list[tuple]) -> dict:
    """The report of one conversation's rows (turn, role, text), nulls as a space, by plain rules."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    seen, faults, told = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        left = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            told[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    told["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    told["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    told["rows"] = [(r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(rows, faults)]
    return told


def dynamic(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[tuple[str, str]]]:
    """As ``exhaustive``, for long conversations: the least (cost, audit, rows) of each state, row by row."""

    def closed(held):
        for _ in range(2):
            for (s, (cost, audit, out)) in list(held.items()):
                who, to = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}[s]
                new = (cost + 5, audit + "I", [*out, (who, "")])
                if to not in held or new[:2] < held[to][:2]:
                    held[to] = new
        return held

    held = {"": (0, "", [])}
    for role, text, gone, cut in rows:
        after: dict = {}

        def offer(s, new, after=after):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new

        for s, (cost, audit, out) in closed(dict(held)).items():
            offer(s, (cost + 2, audit + "D", out))
            if gone:
                continue
            due, to = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}[s]
            if role[:1] == due[0]:
                offer(to, (cost + 5 * cut, audit + "K", [*out, (role, text)]))
            else:
                offer(to, (cost + 1 + 5 * cut, audit + "R", [*out, (due, text)]))
            if s == "" and role[:1] == "s":
                offer("s", (cost + 5 * cut, audit + "K", [*out, (role, text)]))
        held = after
    return min((held_[0], held_[1], held_[2]) for s, held_ in closed(dict(held)).items() if s in ("", "a"))


def hashed(out) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_signatures_against_all_edit_sequences():
    r = random.Random(3)
    for _ in range(150):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), "x", r.random() < 0.2, r.random() < 0.25) for _ in range(r.randint(0, 4))]
        rows = [(a, b, c, d and not c) for a, b, c, d in rows]
        cost, audit, out = exhaustive(rows)
        assert dynamic(rows)[:2] == (cost, audit)
        letters = "".join("x" if gone else (role[0] if role[0] in "sua" else "o").upper() if cut else (role[0] if role[0] in "sua" else "o") for role, _, gone, cut in rows)
        for size in (1, 2, 128):
            answers = [repair.solve(letters[i : i + size]) for i in range(0, len(letters), size)]
            c, steps, closing = repair.path(answers)
            edits = "".join(e for _, e in steps) + closing
            assert (c, edits) == (cost, audit), letters
            if steps:
                steps[-1] = steps[-1][0], steps[-1][1] + closing
            done = [x[1:] for k, (s, e) in enumerate(steps) for x in repair.replay(s, e, [y[0] for y in rows[k * size : (k + 1) * size]], [y[1] for y in rows[k * size : (k + 1) * size]])]
            assert done == out


def assert_repaired(got, want):
    assert got.keys() == want.keys()
    for c, rows in want.items():
        told = sequential(rows)
        cost, audit, out = dynamic(told["rows"])
        g = got[c]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal) == tuple(told[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")), c
        assert (g.cost, g.audit, g.repaired_sha256) == (cost, audit, hashed(out)), c


@pytest.mark.parametrize("chunk", [2, 128])
def test_repairs(spark, chunk):
    rows = some_rows(5)
    r = random.Random(1)
    # a long conversation, a very long text, one row many times
    rows += [(200, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "cut", " "]) + ("" if r.random() < 0.5 else str(t) + "!")) for t in range(700)]
    rows += [(201, 0, "user", "word " * 300_000), (201, 1, "assistant", "fine.")] + [(202, 1, "user", "again.")] * 300
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t, role, text))
    done = repair.Repair(chats(spark, rows), chunk=chunk)
    assert_repaired({x.conv_id: x for x in done.report().collect()}, want)
    turns: dict = {}
    for x in done.turns().orderBy("conv_id", "position").collect():
        turns.setdefault(x.conv_id, []).append((x.role, x.text))
        assert x.position == len(turns[x.conv_id]) - 1
    assert all(hashed(turns.get(c, [])) == x.repaired_sha256 for c, x in {x.conv_id: x for x in done.report().collect()}.items())


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if how == 4:
            role = "user"
        out[c] += [] if how == 0 else [(t, role, text)] * (2 if how == 3 else 1)
    return out


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert_repaired({x.conv_id: x for x in repair.op12_conversation_repair(spark, SF).collect()}, damage(rows))


def test_damage_and_conversations_without_rows(spark):
    rows = some_rows(9) + [(c, 0, "user", "only.") for c in range(1000, 1080)]
    df = chats(spark, rows)
    got = {x.conv_id: x for x in repair.repaired_or_empty(df, repair.Repair(repair.damaged(df)).report()).collect()}
    want = damage(rows)
    assert any(not x for x in want.values())
    assert_repaired(got, want)
    assert repair.repaired_or_empty(df.limit(0), repair.Repair(repair.damaged(df.limit(0))).report()).count() == 0


# --- operator 13


def exact(rows, components=16):
    """Whitening of (id, vector) rows of one length by fractions, then the same eigenvectors."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in fine]
    fit = sorted({tuple(x) for _, x in grid})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    centred = {i: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) for i, x in grid}
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in grid}
    return n, e, q, np.trace(cov), centred, deviation, sorted(i for i, _ in grid)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, dim int, x string")


def test_whitening(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 5)) @ np.diag([9.0, 4.0, 2.0, 0.5, 0.1]) + [0, 1e6, -3, 50, 0.25]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(60, base[3].tolist()), (61, base[3].tolist())]
    bad = [(70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [math.inf, 0, 0, 0, 0]), (73, [math.nan, 0, 0, 0, 0]), (74, []), (75, [1e300, 0, 0, 0, 0])]
    got = whitening.whiten(vectors(spark, [*rows, *[(i, [float(c) if c is not None else None for c in v] if v is not None else None) for i, v in bad]])).collect()
    n, e, q, trace, centred, deviation, ids = exact(rows)
    assert sorted(x.vec_id for x in got if x.component == 1) == ids and {x.component for x in got} == set(range(1, 6)) and {x.n for x in got} == {n} == {60}
    signs = {}
    for x in got:
        k = x.component - 1
        want = centred[x.vec_id] @ q[:, k] / math.sqrt(e[k])
        s = signs.setdefault(k, 1 if want * x.whitened >= 0 else -1)
        assert abs(x.whitened - s * want) < 1e-7 and x.deviation == deviation[x.vec_id]
        assert abs(x.explained / (e[k] / trace) - 1) < 1e-6 and x.identity_error < 1e-9


def test_moments_are_exact(spark):
    r = np.random.default_rng(8)
    x = r.integers(-(2**57), 2**57, (40, 3)).tolist()
    df = spark.createDataFrame([(3, v) for v in x], "dim int, x array<long>").repartition(5)
    want = [[sum(a * b for a, b in zip(u, v)) for v in zip(*[[1, *y] for y in x])] for u in zip(*[[1, *y] for y in x])]
    assert whitening.moments(df) == {3: want}
    p = whitening.primes(10**30)
    assert math.prod(p) > 10**30 and all(all(q % d for d in range(2, 1500)) for q in p)
    for v in (0, 1, -1, 10**29, -(10**29)):
        assert whitening.rebuilt([v % q for q in p], p) == v


def test_whitening_of_odd_tables(spark):
    two = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [3.0, 1.0]), (4, [1.0]), (5, [2.0])])).collect()
    # one dimension doesn't vary: its component has no coordinate; rows repeat, ids may be missing, lengths are apart
    assert sorted(str(x.vec_id) for x in two if x.component == 2) == ["1", "2", "2", "None"]
    assert all((x.whitened is None) == (x.component == 2) for x in two) and all(x.explained in (0.0, 1.0) for x in two)
    assert [x.n for x in two if x.vec_id in (4, 5)] == [2, 2]
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2.0])])).collect()
    assert len(one) == 2 and all(x.whitened is None and x.explained is None and x.identity_error is None and x.deviation == 0 for x in one)
    assert whitening.whiten(vectors(spark, [(1, [0.5])]).limit(0)).count() == 0
    far = whitening.whiten(vectors(spark, [(1, [1e15, 0.0]), (2, [-1e15, 1.0])])).collect()
    assert all(x.deviation is None for x in far)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = whitening.op13_whitening(spark, SF).collect()
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    want = (x - s / n) @ q / np.sqrt(e)
    at = {i: k for k, (i, _) in enumerate(rows)}
    mine = np.zeros_like(want)
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-10
    assert len(got) == 16 * len(rows) and np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-8
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s)) for i, k in at.items()}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
