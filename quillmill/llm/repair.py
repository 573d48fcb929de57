r"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

A conversation's rows, in order, and the states of that pattern (start, after s, after u, after a) span a lattice; its arcs
are edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for a blank or repeated row), Insert an empty
user or assistant row 3; a truncated row that stays adds 3. The shortest path is found by the auction algorithm: every
node has a price, at first a bound of what the rows from there on cost at least; a path grows from its start, extended
by the arc whose cost and end price sum least while that sum equals the price of its last node, else contracted
after the price has been raised to it. A path that reaches the target makes the prices along it exact. Cheapest paths run
along tight arcs (price = cost + price of the end); the wanted one takes at every node the tight arc of the
smallest letter whose end, once its own price has converged, is still tight.

More than ``ROWS`` rows are cut into blocks. Each gets the cost from every state before it to every state after it and, of each
state before, the order of the cheapest paths to the states after: no two of these are alike, nor one the beginning of
another, as inserts stand before a row of the block or after the last row of all. Up to ``ROWS`` blocks are the rows of a
block of the next level, whose arcs have these costs, with the orders for letters, until one is left; from there the
states go down to the rows. A conversation of up to ``LARGE`` rows goes through this in the task where its rows meet. The
rows of a larger one are spread over partitions by range of turn, and its levels are tables.

Defined cases: nulls in a row are one space (for a key, in the damage; for an id, the conversations of null id are one
and come back as null); rows of one turn are ordered by role and by digest of text, null turns first; a role that is
empty adds nothing to the initials, so keeping it costs nothing; a conversation all of whose rows were dropped has zeros, an
empty audit and the digest of the empty text; an empty table gives none; other columns are ignored. A conversation is one row of the
result and its text is digested whole, so a text per block and then one per conversation has to fit into a task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import SLICE, small_batches, table, written

#: Rows of a block, and blocks of a block of the next level; rows of a conversation that meet in one task.
ROWS, LARGE = 32, 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40
#: States: start, after s, after u, after a.
START, S, U, A = range(4)
STATES = range(4)
#: What an inserted or re-roled row leads to, and what it is.
NEXT, ROLE = (U, U, A, U), ("user", "user", "assistant", "user")
_STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A} | {(q, ""): q for q in STATES}
#: Inserts after the last row that make each state an end of the pattern.
TAIL = ("", "II", "I", "")

Arc = tuple[int, int, str]  # cost, node it leads to, letter


class Auction:
    """Shortest paths to ``target`` over arcs of integer cost, without cycles of cost 0.

    ``price`` has for each node a bound of its distance such that no arc's cost and end price sum to less.
    """

    def __init__(self, arcs: Callable[[int], list[Arc]], price: list[int], target: int) -> None:
        self.arcs, self.price, self.target = functools.cache(arcs), price, target
        self.exact = {target}

    def distance(self, start: int) -> int:
        """The exact distance of ``start``; ``FAR`` or more where there is no path."""
        price, path = self.price, [start]
        while path[-1] not in self.exact:
            node = path[-1]
            least, best = min(((cost + price[end], end) for cost, end, _ in self.arcs(node)), default=(FAR, -1))
            if least >= FAR:  # nothing leads on from here
                price[node] = FAR
                self.exact.add(node)
                path = path[:-1] or [node]
            elif price[node] < least:
                price[node] = least
                path = path[:-1] or [node]
            else:
                path.append(best)
        self.exact.update(path)
        return price[start]

    def letters(self, start: int) -> list[Arc]:
        """The arcs of the cheapest path from ``start`` whose letters are least."""
        out, node = [], start
        self.distance(start)
        while node != self.target:
            for arc in sorted(self.arcs(node), key=lambda a: a[2]):
                cost, end, _ = arc
                if cost + self.price[end] == self.price[node] and cost + self.distance(end) == self.price[node]:
                    break
            else:
                raise AssertionError("a converged price without tight arc")
            out.append(arc)
            node = end
        return out


def row_lattice(roles: list[str], faults: str, last: int = A) -> tuple[Callable[[int], list[Arc]], list[int]]:
    """Arcs and first prices of rows: node 4 * i + q is state q before row i. A fault is b, d, t or a blank.

    States that never lead back to ``last`` are left out, as inserts would go round there for ever.
    """
    n, most = len(roles), last if last < U else A

    def arcs(node: int) -> list[Arc]:
        i, q = divmod(node, 4)
        if i >= n:
            return []
        out, after = [(INSERT, 4 * i + NEXT[q], "I"), (DELETE, 4 * (i + 1) + q, "D")], 4 * (i + 1)
        if faults[i] not in "bd":
            more = TRUNCATED if faults[i] == "t" else 0
            out.append((REROLE + more, after + NEXT[q], "R"))
            if (q, roles[i][:1]) in _STEP:
                out.append((KEEP + more, after + _STEP[q, roles[i][:1]], "K"))
        return [arc for arc in out if arc[1] % 4 <= most]

    least = {"b": DELETE, "d": DELETE, "t": min(TRUNCATED, DELETE)}
    bound, price = 0, []
    for f in reversed(" " + faults):  # from the end; the first has no row before it
        price.append([bound] * 4)
        bound += least.get(f, 0)
    return arcs, [p for ps in reversed(price) for p in ps]


def block_lattice(costs: list[list[int]], ranks: list[list[int]]) -> tuple[Callable[[int], list[Arc]], list[int]]:
    """The same of blocks: ``costs[i][4 * p + q]`` leads from state p before block i to q after it, ``ranks`` orders the q of each p."""
    n = len(costs)

    def arcs(node: int) -> list[Arc]:
        i, p = divmod(node, 4)
        return [] if i >= n else [(costs[i][4 * p + q], 4 * (i + 1) + q, str(ranks[i][4 * p + q])) for q in STATES if costs[i][4 * p + q] < FAR]

    price = [[0] * 4]
    for c in reversed(costs):
        price.append([price[-1][0] + min(c)] * 4)
    return arcs, [p for ps in reversed(price) for p in ps]


def transfer(lattice: Callable[[int], tuple], n: int) -> tuple[list[int], list[int]]:
    """Costs from each state before to each state after ``n`` rows or blocks, and the order of the cheapest paths of each state before."""
    costs, paths = [FAR] * 16, {}
    for q in STATES:
        arcs, price = lattice(q)
        auction = Auction(arcs, price, 4 * n + q)
        for p in STATES:
            costs[4 * p + q] = min(auction.distance(p), FAR)
            if costs[4 * p + q] < FAR:
                paths[p, q] = [letter for _, _, letter in auction.letters(p)]
    ranks = [0] * 16
    for p in STATES:
        for k, q in enumerate(sorted((q for q in STATES if (p, q) in paths), key=lambda q: paths[p, q])):
            ranks[4 * p + q] = k
    return costs, ranks


def ended(arcs: Callable[[int], list[Arc]], price: list[int], n: int) -> tuple[Callable[[int], list[Arc]], list[int]]:
    """With the inserts after the last row, which lead on to a node of their own: 4 * n + 4. ``n``: rows or blocks."""
    tail = {4 * n + U: (INSERT, 4 * n + A, "I"), 4 * n + S: (INSERT, 4 * n + U, "I"), 4 * n + START: (0, 4 * n + 4, ""), 4 * n + A: (0, 4 * n + 4, "")}
    return (lambda node: [tail[node]] if node in tail else arcs(node)), [*price, 0]


def boundaries(costs: list[list[int]], ranks: list[list[int]], before: int, after: int, size: int) -> list[int]:
    """The states before each block and after the last one on the cheapest path from ``before`` to ``after``; -1 is the end of the conversation.

    More than ``size`` blocks are made blocks of blocks first.
    """
    n = len(costs)
    if n > size:
        cuts = range(0, n, size)
        made = [transfer(lambda q, lo=lo: block_lattice(costs[lo : lo + size], ranks[lo : lo + size]), min(size, n - lo)) for lo in cuts]
        at = boundaries([c for c, _ in made], [r for _, r in made], before, after, size)
        ends = [*at[1:-1], after]
        return [x for lo, a, b in zip(cuts, at, ends, strict=False) for x in boundaries(costs[lo : lo + size], ranks[lo : lo + size], a, b, size)[:-1]] + [after]
    arcs, price = block_lattice(costs, ranks)
    target = 4 * n + after
    if after < 0:
        (arcs, price), target = ended(arcs, price, n), 4 * n + 4
    path = Auction(arcs, price, target).letters(before)
    return [before, *(end % 4 for _, end, _ in path[: n - 1]), after]


@functools.lru_cache(20_000)
def row_transfer(roles: tuple[str, ...], faults: str) -> tuple[list[int], list[int]]:
    return transfer(lambda q: row_lattice(roles, faults, q), len(roles))


@functools.lru_cache(20_000)
def edits(roles: tuple[str, ...], faults: str, before: int, after: int | None) -> tuple[int, str]:
    """-> cost and letters of the edits of rows from state ``before`` to ``after``; None: to the end of the conversation."""
    arcs, price = row_lattice(roles, faults, A if after is None else after)
    target = 4 * len(roles) + (4 if after is None else after)
    if after is None:
        arcs, price = ended(arcs, price, len(roles))
    path = Auction(arcs, price, target).letters(before)
    return sum(cost for cost, _, _ in path), "".join(letter for _, _, letter in path)


def whole_plan(roles: list[str], faults: str, size: int = ROWS) -> tuple[int, str]:
    """-> cost and letters of the edits of a whole conversation."""
    n = len(roles)
    if n <= size:
        return edits(tuple(roles), faults, START, None)
    parts = [(tuple(roles[lo : lo + size]), faults[lo : lo + size]) for lo in range(0, n, size)]
    made = [row_transfer(*p) for p in parts]
    at = boundaries([c for c, _ in made], [r for _, r in made], START, -1, size)
    done = [edits(*p, a, None if b < 0 else b) for p, a, b in zip(parts, at, at[1:], strict=False)]
    return sum(c for c, _ in done), "".join(e for _, e in done)


def applied(roles: list[str], texts: list[str], audit: str, before: int) -> list[str]:
    """The rows, as ``role:text``, that the edits leave."""
    out, i, q = [], 0, before
    for e in audit:
        if e in "IR":
            out.append(f"{ROLE[q]}:{texts[i] if e == 'R' else ''}")
            q = NEXT[q]
        elif e == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            q = _STEP[q, roles[i][:1]]
        i += e != "I"
    return out


# ---- the rows

_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_KINDS |= {f"array<{n}>": pa.list_(t) for n, t in _KINDS.items()}
_KINDS |= {f"array<array<{n}>>": pa.list_(pa.list_(_KINDS[n])) for n in ("long", "int")}


def _rows(made: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in made], _KINDS[t]) for j, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """-> conv, known, turn, role, text, copies: rows dropped, emptied, cut, repeated or re-roled by the checksum of their key.

    ``known`` is false for a null turn, which is 0 then. A dropped row stays with 0 copies, so that its conversation does.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    at = F.coalesce(F.col(turn).cast("long"), F.lit(0))
    given = rows.select(space(conv).alias("conv"), F.col(turn).isNotNull().alias("known"), at.alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))
    return given.select(
        "conv",
        "known",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _own_fault(text: str) -> Column:
    """b for a blank text, t for one that ends amid a sentence, else a blank."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise(" ")


def faulty(rows: DataFrame) -> DataFrame:
    """Rows as ``damaged`` makes them -> conv, known, turn, role, digest, text, n (copies), fault (of the first of them).

    Equal rows of a turn are one with a number of copies. The first row of each role and text is found by a minimum, which
    is merged before it is shuffled, and joined back on the whole row, so no conversation or text gathers in a task.
    """
    key = ["conv", "known", "turn", "role", "digest"]
    keyed = rows.where("copies > 0").withColumn("digest", F.md5("text"))
    same = keyed.groupBy(*key).agg(F.sum("copies").alias("n"), F.min("text").alias("text"))
    first = keyed.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("m")).select("conv", "m.known", "m.turn", "role", "digest", F.lit(True).alias("first"))
    joined = same.join(first.hint("shuffle_merge"), key, "left")
    own = _own_fault("text")
    fault = F.when(own == "b", own).when(F.col("first").isNull(), "d").otherwise(own)
    return joined.select(*key, "text", "n", fault.alias("fault"))


_LEAF = "conv string, part long, seq int, roles array<string>, faults string, texts array<string>, illegal long, head string, last string, lo long, hi long, turns long"


class _Cutter:
    """Cuts rows that come in order into blocks of up to ``size`` rows of a conversation."""

    def __init__(self, size: int) -> None:
        self.size, self.conv, self.out = size, None, []
        self.seq, self.last, self.hi = 0, None, None
        self.clear()

    def clear(self) -> None:
        self.roles, self.faults, self.texts, self.turns = [], [], [], []

    def add(self, r: dict) -> None:
        if r["conv"] != self.conv:
            self.close()
            self.conv, self.seq, self.last, self.hi = r["conv"], 0, None, None
        again = r["fault"] if r["fault"] == "b" else "d"
        for k in range(r["n"]):
            self.roles.append(r["role"])
            self.faults.append(again if k else r["fault"])
            self.texts.append("" if k else r["text"])
            if r["known"]:
                self.turns.append(r["turn"])
            self.part = r["part"]
            if len(self.roles) == self.size:
                self.close()

    def close(self) -> None:
        if not self.roles:
            return
        initials = [r[:1] for r in self.roles]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials if self.last is None else [self.last, *initials]))
        lo, hi = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        turns = len(set(self.turns) - {self.hi})
        head = initials[0] if self.last is None else None
        self.out.append((self.conv, self.part, self.seq, self.roles, "".join(self.faults), self.texts, bad, head, initials[-1], lo, hi, turns))
        self.seq, self.last, self.hi = self.seq + 1, initials[-1], self.hi if hi is None else hi
        self.clear()

    def take(self) -> pa.RecordBatch:
        made, self.out = _rows(self.out, _LEAF), []
        return made


def leaves(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Blocks of up to ``size`` rows of a conversation in order of turn; (part, seq) orders a conversation's blocks.

    ``illegal`` counts the pairs of neighbours inside and, in the same partition, with the block before; ``head`` is the
    first initial where there is none before. ``turns`` counts the turns that are not the block's before.
    """
    order = ["conv", "known", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv", "known", "turn", "role", "text", "n", "fault")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(size)
        for batch in batches:
            for r in batch.to_pylist():
                cutter.add(r)
                if len(cutter.out) >= SLICE:
                    yield cutter.take()
        cutter.close()
        yield cutter.take()

    return written(small_batches(dealt).mapInArrow(work, _LEAF), "repair-blocks")


# ---- conversations of more than one block: costs go up, states come down


_NODE = "conv string, part long, seq int, costs array<long>, ranks array<int>"
_PARENT = _NODE + ", child_part array<long>, child_seq array<int>, child_costs array<array<long>>, child_ranks array<array<int>>"


def _leaf_nodes(blocks: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(r["conv"], r["part"], r["seq"], *row_transfer(tuple(r["roles"]), r["faults"])) for r in batch.to_pylist()], _NODE)

    return blocks.select("conv", "part", "seq", "roles", "faults").mapInArrow(work, _NODE)


def _parents(nodes: DataFrame, size: int) -> DataFrame:
    order = ["conv", "part", "seq"]
    dealt = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("here"), *nodes.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq, out = [], 0, []

        def close() -> None:
            nonlocal seq
            if held:
                costs, ranks = [r["costs"] for r in held], [r["ranks"] for r in held]
                made = transfer(lambda q: block_lattice(costs, ranks), len(held))
                out.append((held[0]["conv"], held[0]["here"], seq, *made, [r["part"] for r in held], [r["seq"] for r in held], costs, ranks))
                seq += 1
                held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv"] != held[0]["conv"] or len(held) == size):
                    close()
                held.append(r)
            if out:
                yield _rows(out, _PARENT)
                out.clear()
        close()
        if out:
            yield _rows(out, _PARENT)

    return written(dealt.mapInArrow(work, _PARENT), "repair-level")


_STATES = "conv string, part long, seq int, before int, after int"


def _children(parents: DataFrame, size: int) -> DataFrame:
    """Parents with the states before and after them -> those of their children; ``after`` -1 is the end of the conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = boundaries(r["child_costs"], r["child_ranks"], r["before"], r["after"], size)
                out += [(r["conv"], p, s, a, b) for p, s, a, b in zip(r["child_part"], r["child_seq"], at, at[1:], strict=False)]
            yield _rows(out, _STATES)

    return written(parents.mapInArrow(work, _STATES), "repair-states")


def block_states(blocks: DataFrame, size: int = ROWS) -> DataFrame:
    """-> conv, part, seq, before, after: the states around each block on its conversation's cheapest path."""
    nodes, levels = _leaf_nodes(blocks), []
    while True:
        levels.append(_parents(nodes, size))
        nodes = levels[-1].select("conv", "part", "seq", "costs", "ranks")
        if nodes.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    states = nodes.select("conv", "part", "seq", F.lit(START).alias("before"), F.lit(-1).alias("after"))
    for level in reversed(levels):
        states = _children(level.drop("costs", "ranks").join(states.hint("shuffle_merge"), ["conv", "part", "seq"]), size)
    return states


_FIXED = "conv string, part long, seq int, cost long, audit string, repaired string, blank long, duplicate long, truncated long, illegal long, head string, last string, lo long, hi long, turns long"
_SUMS = ["cost", "blank", "duplicate", "truncated", "illegal"]


def repaired(blocks: DataFrame) -> DataFrame:
    """Blocks with the states around them -> their cost, edits, rows after them (null: none) and counts of faults."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            out = []
            for r in batch.to_pylist():
                roles, faults, before = r["roles"], r["faults"], r["before"]
                cost, audit = edits(tuple(roles), faults, before, None if r["after"] < 0 else r["after"])
                rows = applied(roles, r["texts"], audit, before)
                counts = [faults.count(f) for f in "bdt"]
                out.append((r["conv"], r["part"], r["seq"], cost, audit, "\n".join(rows) if rows else None, *counts, *(r[c] for c in ("illegal", "head", "last", "lo", "hi", "turns"))))
            yield _rows(out, _FIXED)

    return small_batches(blocks).mapInArrow(work, _FIXED)


def _gathered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a key made one, in ``order``: sums, texts in a row, what stands between two neighbours counted."""
    ends = ["audit", "repaired", "head", "last", "lo", "hi"]
    b = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (*_SUMS, "turns")), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct(order, *ends))).alias("b"))
    joined = lambda c, sep: F.array_join(F.filter(F.transform("b", lambda x: x[c]), lambda x: x.isNotNull()), sep)
    text = F.when(F.exists("b", lambda x: x["repaired"].isNotNull()), joined("repaired", "\n"))
    met = F.transform("b", lambda x, i: F.when(i > 0, F.concat(F.get("b", i - 1)["last"], x["head"])))  # null where the head was counted
    again = F.transform("b", lambda x, i: F.when((i > 0) & x["head"].isNotNull(), F.get("b", i - 1)["hi"] == x["lo"]))
    return b.select(
        *keys, "cost", "blank", "duplicate", "truncated", (F.col("illegal") + F.size(F.filter(met, lambda x: ~x.isin("su", "ua", "au")))).alias("illegal"),
        (F.col("turns") - F.size(F.filter(again, lambda x: x))).alias("turns"), "lo", "hi",
        joined("audit", "").alias("audit"), text.alias("repaired"), F.col("b")[0]["head"].alias("head"), F.element_at("b", -1)["last"].alias("last"),
    )


# ---- conversations that fit into a task

_DONE = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def _in_tasks(rows: DataFrame, size: int) -> DataFrame:
    """Conversations of a bounded number of rows, each repaired where its rows meet: one shuffle."""
    keyed = rows.select("conv", "known", "turn", "role", F.md5("text").alias("digest"), "text", "copies", _own_fault("text").alias("own"))
    dealt = keyed.repartition("conv").sortWithinPartitions("conv", "known", "turn", "role", "digest")

    def finished(conv: str, held: list[dict]) -> tuple:
        roles, faults, texts, seen = [], [], [], set()
        for r in held:
            for _ in range(r["copies"]):
                again = (r["role"], r["digest"]) in seen
                roles.append(r["role"])
                texts.append(r["text"])
                faults.append("d" if again and r["own"] != "b" else r["own"])
                seen.add((r["role"], r["digest"]))
        turns = [r["turn"] for r in held if r["known"] and r["copies"]]
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairwise(roles))
        cost, audit = whole_plan(roles, "".join(faults), size)
        return conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, "\n".join(applied(roles, texts, audit, START))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            for r in batch.to_pylist():
                if held and r["conv"] != held[0]["conv"]:
                    out.append(finished(held[0]["conv"], held))
                    held = []
                held.append(r)
            if out:
                yield _rows(out, _DONE)
                out = []
        if held:
            yield _rows([finished(held[0]["conv"], held)], _DONE)

    return small_batches(dealt).mapInArrow(work, _DONE)


def repair(rows: DataFrame, kind: str, size: int = ROWS, large: int = LARGE) -> DataFrame:
    """``rows`` as ``damaged`` makes them, ``kind`` the type of the ids -> the conversations repaired:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (the text).
    """
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    many = written(sizes.where((F.col("n") > large) | (F.col("rows") > large)).select("conv"), "repair-large")  # one in ``large`` rows at most
    back = F.when(F.col("conv") != " ", F.col("conv")).cast(kind).alias("conv_id")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    if many.isEmpty():
        return _in_tasks(rows, size).select(back, *columns)
    found = _in_tasks(rows.join(many.hint("shuffle_hash"), "conv", "left_anti"), size)
    blocks = leaves(written(faulty(rows.join(many.hint("shuffle_hash"), "conv", "left_semi")), "repair-rows"), size)
    fixed = repaired(blocks.join(block_states(blocks, size).hint("shuffle_hash"), ["conv", "part", "seq"]))
    merged = _gathered(_gathered(fixed, ["conv", "part"], "seq"), ["conv"], "part")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    merged = merged.select("conv", gaps, *columns[1:-1], F.coalesce("repaired", F.lit("")).alias("repaired"))
    gone = many.join(blocks.select("conv").distinct().hint("shuffle_hash"), "conv", "left_anti")  # large, yet all of it dropped
    zeros = gone.select("conv", *(F.lit(0).cast("long").alias(c) for c in columns[:-2]), F.lit("").alias("audit"), F.lit("").alias("repaired"))
    return found.unionByName(merged).unionByName(zeros).select(back, *columns)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    done = repair(damaged(given), given.schema["conv_id"].dataType.simpleString())
    return done.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
