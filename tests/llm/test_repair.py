"""Conversation repair against a dynamic program over all edits, by rows in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from quillmill.llm import repair as R

BLANK = " \t\n\x0b\x0c\r"
STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plan(rows):
    """(cost, audit) of the rows (role, fault), least cost, then least letters: relaxed backwards until nothing changes."""
    n = len(rows)
    best = {(n, q): (0, "") for q in "0a"}
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in "0sua":
                nxt = {"u": "a"}.get(q, "u")
                ways = [best[i, q]] if (i, q) in best else []
                if (i, nxt) in best:
                    ways.append((3 + best[i, nxt][0], "I" + best[i, nxt][1]))
                if i < n:
                    role, fault = rows[i]
                    after = lambda to, cost, e: ways.append((cost + best[i + 1, to][0], e + best[i + 1, to][1])) if (i + 1, to) in best else None  # noqa: B023, E731
                    after(q, 4, "D")
                    if fault not in ("b", "d"):
                        more = 3 * (fault == "t")
                        after(nxt, 3 + more, "R")
                        to = q if role[:1] == "" else STEP.get((q, role[:1]))
                        if to:
                            after(to, more, "K")
                if ways:
                    best[i, q] = min(ways)
    return best[0, "0"]


def left(rows, audit):
    out, i, q = [], 0, "0"
    for e in audit:
        nxt = {"u": "a"}.get(q, "u")
        name = {"u": "user", "a": "assistant"}[nxt]
        if e == "I":
            out.append(f"{name}:")
            q = nxt
            continue
        role, text = rows[i]
        i += 1
        if e == "R":
            out.append(f"{name}:{text}")
            q = nxt
        elif e == "K":
            out.append(f"{role}:{text}")
            q = q if role[:1] == "" else STEP[q, role[:1]]
    return "\n".join(out)


def brute(given):
    out, convs = [], {}
    for c, t, r, x in given:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for c, rows in convs.items():
        kept = []
        for t, r, x in rows:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if kind:
                row = (t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
                kept += [row] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in kept:
            body = x.strip(BLANK)
            faults.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else " ")
            seen.add((r, x))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = plan([(r, f) for (_, r, _), f in zip(kept, faults)])
        out.append((c, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, left([(r, x) for _, r, x in kept], audit)))
    return sorted(out, key=str)


def got(spark, rows, **options):
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return sorted((tuple(r) for r in R.repair(R.damaged(given), "bigint", **options).collect()), key=str)


def made(seed, n_convs, longest):
    draw = random.Random(seed)
    rows = []
    for c in range(n_convs):
        n = draw.randint(1, longest)
        for t in range(n):
            role = draw.choice(["user", "assistant"][t % 2 :] if draw.random() < 0.7 else ["system", "user", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "Why? ", "no", "", " \n", f"Text {draw.randint(0, 9)}!", f"cut {t}", "So. ", None])
            rows.append((c, draw.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_auction_finds_the_least_plan(seed):
    draw = random.Random(seed)
    for _ in range(150):
        rows = [(draw.choice(["user", "assistant", "system", "x", ""]), draw.choice("   bdt")) for _ in range(draw.randint(0, 14))]
        cost, audit = R.edits(tuple(r for r, _ in rows), "".join(f for _, f in rows), R.START, None)
        assert (cost, audit) == plan(rows)


def test_blocks_lead_to_the_same_plan():
    draw = random.Random(7)
    for _ in range(60):
        rows = [(draw.choice(["user", "assistant", "system"]), draw.choice("    bdt")) for _ in range(draw.randint(5, 30))]
        parts = [rows[i : i + 4] for i in range(0, len(rows), 4)]
        made = [R.row_transfer(tuple(r for r, _ in p), "".join(f for _, f in p)) for p in parts]
        states = R.boundaries([c for c, _ in made], [r for _, r in made], R.START, -1, 3)
        ends = [*states[1 : len(parts)], None]
        done = [R.edits(tuple(r for r, _ in p), "".join(f for _, f in p), a, b) for p, a, b in zip(parts, states, ends)]
        assert (sum(c for c, _ in done), "".join(a for _, a in done)) == plan(rows)


def test_repair_equals_brute_force(spark):
    rows = made(1, 120, 9)
    rows += [(500, t, "user" if t % 3 else "assistant", f"Line {t}." if t % 5 else "Line") for t in range(700)]  # three levels of blocks
    rows += [(None, t, "user", "Null id.") for t in range(4)] + [(501, 1, "user", "Same.")] * 9 + [(502, None, None, None)]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    want = brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", "") in want
    rows += [(c, 0, "user", "Gone.") for c in [dropped] * 30]
    assert got(spark, rows, size=6, large=20) == want  # levels as tables
    assert got(spark, rows, size=6) == want
    assert got(spark, rows) == want


def test_repair_of_odd_tables(spark):
    assert got(spark, []) == []
    given = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3, "t"), (1, 1, "assistant", "é" * 300_000, None, 4, "b")], "conv_id int, turn int, role string, text string, conv string, part int, fault string")
    assert [tuple(r) for r in R.repair(R.damaged(given), "int").collect()] == brute([(1, 0, "user", "Hi."), (1, 1, "assistant", "é" * 300_000)])
