"""Fuzzy line deduplication: SimHash blocks and min-hash bands, edit similarity, one occurrence per connected group.

A line is normalised (A-Z lower-cased, digits to 0, ASCII punctuation to blanks, white space collapsed). Its SimHash is the
sign of the sum of its words' hashes, 64 bits, each word with the weight of its length less two. Lines meet by the pigeonhole
principle if two of the four blocks of their SimHashes agree, as they do wherever two bits differ at most. An edit similarity of
0.8 moves more bits than that in short lines, so lines also meet by min-hashes: lines of up to ``FEW`` words by their words, with
the same weights, lines of ``MANY`` words or more by their pairs of neighbouring words; those between by both. Of these features ``BANDS`` times
``ROWS`` min-hashes are taken, and lines that agree in all rows of a band meet. Lines that meet are linked if the edit
similarity of the normalised lines, 1 - distance / longer length, is at least ``SIMILARITY``; bounds that hold for every pair of
texts spare most of the distances, and what is connected already is not compared; every other pair of a group is,
whatever the group's size. Equal lines are one node from the start. Of each connected group the first occurrence stays (smallest document id, then line) and all
others go. Meeting is a matter of chance, the likelier the more two lines share; a test measures the recall of both ways against all pairs.

Where a line has fewer than ``MIN_WORDS`` words, as in scripts without blanks, its runs of ``GRAM`` bytes take the place
of words, from ``LONG`` letters on; shorter ones go only as exact repeats: of the normalised line from ``MIN_LETTERS``
letters on, else of the line itself without the blanks around it. Lines without a letter or digit always stay.
A distinct line is known by 128 bits of hash.

Defined cases: a null text stays null and an empty one empty; repeated rows of one id and text count as one document
and get the same result; a null id comes before all others; other columns pass through; a text may become empty.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import handing_back, small_batches, table, written
from quillmill.llm.groups import BLOCK, Forest, block_pairs, components, runs

MIN_WORDS, SIMILARITY = 5, 0.8
#: Letters from which a line of fewer words goes as an exact repeat of its normalised form, and takes part in full.
MIN_LETTERS, LONG, GRAM = 10, 30, 6
#: Lines of up to FEW words have words as features, those of MANY or more have pairs of words.
FEW, MANY = 20, 13
#: Bands of a line by kind of feature, rows of a band.
BANDS, ROWS = {"words": 12, "pairs": 8}, {"words": 4, "pairs": 3}
#: Blocks of a SimHash; two of them that agree are a key.
BLOCKS = 4
#: Members from which a group's texts first meet ``CENTRES`` of them, which links most, and then the others one by one, nearest first.
LARGE, CENTRES = 8, 4
#: Pairs of texts whose distances are computed together; fewer than these go one by one.
TOGETHER, FEW_PAIRS = 2048, 24
#: Columns after which a pair that is compared alone leaves if it is too far apart.
STEP = 16
#: What a column costs: of one pair alone; of all pairs together, for the column and for each pair's word of 64 bits.
ALONE, COLUMN, WORD = 0.6, 60.0, 0.06
#: Bits of the tables of places that are kept for a text's next pairs.
KNOWN_BITS = 1 << 26
#: Words of 64 bits of the texts that are compared together, and columns after which pairs too far apart leave.
WIDE, EXIT = 60, 32
#: Members of groups, and more, that are compared together, and those that a task gets, about.
MEMBERS, MEMBERS_A_TASK = 16_384, 10_000
#: Bytes of a band's key in the table of lines.
KEY = 5
#: Lists of lines up to this many bytes are broadcast to the documents; larger ones are joined by shuffling both sides.
BROADCAST_BYTES = 32_000_000
_R = np.random.default_rng(20240501)
_FACTORS, _TERMS = _R.integers(0, 1 << 32, (2, max(BANDS[k] * ROWS[k] for k in BANDS)), np.uint32)
_FACTORS |= np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 or c == 10 else 32 for c in range(256)
)


def normal_lines(text: str) -> list[list[bytes]]:
    """The words of each line's normalised form."""
    return [line.split() for line in text.encode().translate(_TABLE).split(b"\n")]


def letters(words: list[bytes]) -> int:
    """Characters of a line, without the blanks between its words."""
    return sum(len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in words)


def tokens(words: list[bytes], min_words: int = MIN_WORDS) -> list[bytes]:
    """The words, or runs of bytes where there are too few of them."""
    if len(words) >= min_words:
        return words
    line = b" ".join(words)
    return [line[i : i + GRAM] for i in range(max(len(line) - GRAM + 1, 1))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def _keys(lines: list[list[bytes]], kind: str) -> np.ndarray:
    """lines as tokens -> a row of ``BANDS`` keys each; for pairs every line needs two tokens."""
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = list(chain.from_iterable(lines))
    h = np.fromiter(map(xxhash.xxh32_intdigest, flat), np.uint64, len(flat))
    starts = np.cumsum(counts) - counts
    if kind == "words":
        size = np.fromiter(map(len, flat), np.float32, len(flat))
        weight = 1 / np.maximum(size - 2, np.float32(0.3))
    else:
        own = np.ones(len(h), bool)
        own[starts + counts - 1] = False
        h = (h * np.uint64(3) + _MIX * np.append(h[1:], h[:1]))[own]
        starts = starts - np.arange(len(starts))
    h = (_mixed(h) >> np.uint64(32)).astype(np.uint32)
    x, keys = np.empty_like(h), np.empty((len(lines), BANDS[kind]), np.uint64)
    for band in range(BANDS[kind]):
        key = np.full(len(lines), 2 * band + (kind == "words"), np.uint64)
        for k in range(band * ROWS[kind], (band + 1) * ROWS[kind]):
            np.multiply(h, _FACTORS[k], out=x)
            x += _TERMS[k]
            if kind == "words":  # the least of an exponential variable of this rate, with bits that tell whose it was
                y = np.log((x >> np.uint32(8)).astype(np.float32) + np.float32(0.5)) - np.float32(24 * np.log(2))
                y *= -weight
                least = np.minimum.reduceat(y.view(np.uint32).astype(np.uint64) << np.uint64(32) | h, starts)
            else:
                least = np.minimum.reduceat(x, starts).astype(np.uint64)
            key = _mixed(key * np.uint64(5) + _mixed(least + np.uint64(k)))
        keys[:, band] = key
    return keys


def simhashes(lines: list[list[bytes]]) -> np.ndarray:
    """lines as tokens, none empty -> their SimHashes."""
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = list(chain.from_iterable(lines))
    h = _mixed(np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat)))
    weight = np.maximum(np.fromiter(map(len, flat), np.float32, len(flat)) - 2, np.float32(0.3))
    signs = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    signs -= np.float32(0.5)
    signs *= weight[:, None]
    total = np.add.reduceat(signs, np.cumsum(counts) - counts)
    return np.packbits(total > 0, axis=1).view(np.uint64)[:, 0]


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each two blocks of a SimHash: two hashes of which two bits differ at most have one in common."""
    width = 64 // BLOCKS
    block = hashes[:, None] >> (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(width)) & np.uint64((1 << width) - 1)
    pairs = list(combinations(range(BLOCKS), 2))
    keys = [_mixed((block[:, a] << np.uint64(width) | block[:, b]) * np.uint64(64) + np.uint64(1000 + k)) for k, (a, b) in enumerate(pairs)]
    return np.stack(keys, axis=1)


def band_keys(lines: list[list[bytes]], kinds: tuple[str, ...] = ("simhash", *BANDS)) -> list[bytes]:
    """lines as tokens -> the keys of each in a row, ``KEY`` bytes a key."""
    out = [b""] * len(lines)
    takes = {"simhash": lambda t: t, "words": lambda t: len(t) <= FEW, "pairs": lambda t: len(t) >= MANY}
    for kind in kinds:
        some = [i for i, t in enumerate(lines) if takes[kind](t)]
        lo = 0
        while lo < len(some):  # some 20,000 tokens at a time
            hi, size = lo + 1, len(lines[some[lo]])
            while hi < len(some) and size + len(lines[some[hi]]) <= 20_000:
                size += len(lines[some[hi]])
                hi += 1
            part = [lines[i] for i in some[lo:hi]]
            keys = np.ascontiguousarray(block_keys(simhashes(part)) if kind == "simhash" else _keys(part, kind))
            raw = np.ascontiguousarray(keys.view(np.uint8).reshape(hi - lo, -1, 8)[:, :, :KEY]).reshape(hi - lo, -1)
            for i, r in zip(some[lo:hi], raw, strict=True):
                out[i] += r.tobytes()
            lo = hi
    return out


def places(text: str) -> dict[str, int]:
    """Where each character stands in a text, a bit for each place."""
    out, bit = dict.fromkeys(text, 0), 1
    for c in text:
        out[c] |= bit
        bit <<= 1
    return out


def distance_up_to(peq: dict[str, int], m: int, b: str, most: float) -> tuple[int, bool]:
    """The distance of ``b`` from a text of ``m`` characters given by its places, and whether it is exact: else a bound below, beyond ``most``.

    Distances never fall along a diagonal, so the one that leads to the end tells every ``STEP`` columns whether it is too far already.
    """
    n = len(b)
    if not m or not n:
        return m + n, True
    mask = (1 << m) - 1
    vp, vn, get = mask, 0, peq.get
    for lo in range(0, n, STEP):
        for c in b[lo : lo + STEP]:
            eq = get(c, 0)
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
            hn = d0 & vp
            hp = (vn | mask ^ (d0 | vp)) << 1 | 1
            vp, vn = (hn << 1 | mask ^ (d0 | hp) & mask) & mask, d0 & hp
        j = min(lo + STEP, n)
        row = m - n + j
        if row > 0:
            own = (1 << row) - 1
            now = j + (vp & own).bit_count() - (vn & own).bit_count()
            if now > most:
                return now, j == n
    return now, True


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the shorter text, ends in common cut off first."""
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    vp, vn = mask, 0
    for c in b:
        eq = peq.get(c, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = vn | ~(d0 | vp) & mask, d0 & vp
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = (hp << 1 | 1) & mask, hn << 1 & mask
        vp, vn = hn | ~(d0 | hp) & mask, d0 & hp
    return score


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The same for many pairs at a time."""
    return least_distances(a, b, np.full(len(a), np.inf))[0].astype(np.int64)


def least_distances(a: list[str], b: list[str], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances of many pairs, and which are exact: the others are bounds below, beyond the pair's ``most``.

    All pairs go a column each step, in words of 64 bits, those with the longest texts first, so that the ones that end drop off the end.
    Every ``EXIT`` columns those go whose way through any row of the column is too far already.
    """
    m, n = (np.fromiter(map(f, map(len, a), map(len, b)), np.int64, len(a)) for f in (min, max))
    order = np.argsort(-n, kind="stable")
    low, exact = np.zeros(len(a)), np.ones(len(a), bool)
    a, b = ([f(a[k], b[k], key=len) if len(a[k]) != len(b[k]) else (a, b)[f is max][k] for k in order] for f in (min, max))
    m, n, most, pairs, words = m[order], n[order], most[order], len(a), int(-(-m.max() // 64)) or 1
    alphabet, codes = np.unique(np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    if pairs > 1 and len(alphabet) * words * pairs > 2_000_000:  # in scripts of many characters fewer pairs at a time
        parts = [least_distances(a[x], b[x], most[x]) for x in (slice(0, pairs // 2), slice(pairs // 2, None))]
        low[order], exact[order] = (np.concatenate(x) for x in zip(*parts, strict=True))
        return low, exact
    left, right = codes[: m.sum()], codes[m.sum() :]
    row, place = np.repeat(np.arange(pairs), m), np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
    holds = np.zeros((len(alphabet), pairs, words), np.uint64)  # where in a each character stands
    np.bitwise_or.at(holds, (left, row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    holds = holds.reshape(-1, words)
    text = np.zeros((n.max(), pairs), np.int64)
    text[np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(pairs), n)] = right * pairs + np.repeat(np.arange(pairs), n)
    one, place, rows = np.uint64(1), np.arange(words)[:, None], 8 * np.arange(1, 8 * words + 1)
    here = np.clip(m - 64 * place, 0, 64).astype(np.uint64)  # bits of each word that are rows of the pair
    inside = np.where(here == 64, ~np.uint64(0), (one << (here & np.uint64(63))) - one)
    vp, vn, act, ends = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64), np.arange(pairs), n
    for j in range(n.max() + 1):
        if ends[-1] == j:
            go = int(np.searchsorted(-ends, -j))
            done = act[go:]
            ups, downs = (np.bitwise_count(v[:, go:] & inside[:, done]).sum(axis=0, dtype=np.int64) for v in (vp, vn))
            low[order[done]] = j + ups - downs
            vp, vn, act, ends = vp[:, :go], vn[:, :go], act[:go], ends[:go]
            if not go:
                break
        if j and j % EXIT == 0:
            ups, downs = (np.bitwise_count(np.ascontiguousarray(v.T).view("<u8").view(np.uint8)).astype(np.int64) for v in (vp, vn))
            far = np.cumsum(ups - downs, axis=1) + j + np.abs((m[act] - ends + j)[:, None] - rows)
            far = np.minimum(np.where(rows <= m[act][:, None], far, 1 << 40).min(axis=1), j + np.abs(m[act] - ends + j))
            far -= 16  # of eight rows one is looked at, seven at most from any other one
            stay = far <= most[act]
            if not stay.all():
                gone = act[~stay]
                low[order[gone]], exact[order[gone]] = far[~stay], False
                vp, vn, act, ends = vp[:, stay], vn[:, stay], act[stay], ends[stay]
                if not len(act):
                    break
        eq = holds[text[j][act]].T
        x = eq & vp
        total = x + vp
        if words > 1:  # carries between the words, all at once: one that is full passes a carry on, one that ran over makes one
            made, full = ((total < x).astype(np.int64) << place).sum(axis=0), ((total == ~np.uint64(0)).astype(np.int64) << place).sum(axis=0)
            full |= made
            total += ((((full + made) ^ full ^ made) >> place) & 1).astype(np.uint64)
        d0 = (total ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        hp1, hn1 = hp << one, hn << one
        if words > 1:
            hp1[1:] |= hp[:-1] >> np.uint64(63)
            hn1[1:] |= hn[:-1] >> np.uint64(63)
        hp1[0] |= one
        vp, vn = hn1 | ~(d0 | hp1), d0 & hp1
    return low, exact


def _aligned(v: list[str], w: list[str], most: float) -> float:
    """The edits of a walk through both texts' words, past up to four of each that differ; it ends beyond ``most``."""
    i = j = cost = 0
    while i < len(v) and j < len(w) and cost <= most:
        if v[i] == w[j]:
            i, j = i + 1, j + 1
            continue
        for d in range(1, 5):
            ways = [(x, d - x) for x in range(d + 1) if i + x < len(v) and j + d - x < len(w) and v[i + x] == w[j + d - x]] or [(x, y) for x, y in ((d, d),) if i + d < len(v) and j + d < len(w) and v[i + d] == w[j + d]]
            if ways:
                x, y = min(ways, key=lambda z: abs(z[0] - z[1]))
                break
        else:
            x, y = len(v) - i, len(w) - j
        cost += max(sum(map(len, v[i : i + x])) + x, sum(map(len, w[j : j + y])) + y)
        i, j = i + x, j + y
    return cost + max(sum(map(len, v[i:])) + len(v) - i, sum(map(len, w[j:])) + len(w) - j)


def bounded(a: list[str], b: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of each pair's edit distance that leave no doubt whether the similarity is ``least`` or more.

    Where the lengths or a walk through the words can tell, no distance is computed.
    """
    low, high, open_ = np.zeros(len(a)), np.full(len(a), np.inf), []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        most = allowed(max(len(x), len(y)), least)
        low[k] = abs(len(x) - len(y))
        if low[k] > most:
            continue
        v, w = x.split(" "), y.split(" ")
        cost = sum(max(len(p), len(q)) for p, q in zip(v, w, strict=True) if p != q) if len(v) == len(w) else np.inf
        cost = cost if cost <= most else _aligned(v, w, most)
        if cost <= most:
            high[k] = cost
        else:
            open_.append((k, x, y, max(1, -(-min(len(x), len(y)) // 64))))
    open_.sort(key=lambda z: z[3])
    for _, many in groupby(open_, key=lambda z: (z[3] > 2) + (z[3] > 8) + (z[3] > WIDE)):
        many = list(many)
        for lo in range(0, len(many), TOGETHER):
            part = many[lo : lo + TOGETHER]
            at = np.array([z[0] for z in part])
            longer = np.array([max(len(z[1]), len(z[2])) for z in part])
            most = allowed(longer, least)
            alone = ALONE * longer.sum() < COLUMN * longer.max() + WORD * part[-1][3] * longer.sum()
            if part[-1][3] > WIDE:
                low[at] = high[at] = [edit_distance(z[1], z[2]) for z in part]
            elif alone or len(part) < FEW_PAIRS:
                known: dict[str, dict[str, int]] = {}
                bits = 0
                for z, limit in zip(part, most.tolist(), strict=True):
                    x, y = (z[1], z[2]) if z[1] in known or z[2] not in known else (z[2], z[1])
                    if x not in known:
                        if bits > KNOWN_BITS:
                            known, bits = {}, 0
                        known[x] = places(x)
                        bits += (len(x) + 512) * len(known[x])
                    far, exact = distance_up_to(known[x], len(x), y, limit)
                    low[z[0]] = max(low[z[0]], far)
                    high[z[0]] = far if exact else np.inf
            else:
                far, exact = least_distances([z[1] for z in part], [z[2] for z in part], most)
                low[at] = np.maximum(low[at], far)
                high[at] = np.where(exact, far, np.inf)
    return low, high


def allowed(longer, least: float):
    """The edits that two texts may be apart, by the length of the longer one."""
    return (1 - least) * longer + 1e-9


def similar(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Which pairs of texts have an edit similarity of ``least`` or more."""
    return bounded(a, b, least)[1] <= np.array([allowed(max(len(x), len(y)), least) for x, y in zip(a, b, strict=True)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text 1024 bits that tell which runs of three characters it has, and its length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), 1024), bool)
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row, place = np.repeat(np.arange(len(texts)), sizes), np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.flatnonzero(place < np.repeat(sizes, sizes) - 2)
    h = (raw[own] * np.uint32(961) + raw[own + 1] * np.uint32(31) + raw[own + 2]) * np.uint32(0x9E3779B1) >> np.uint32(22)
    out[row[own], h] = True
    return np.packbits(out, axis=1).view(np.uint64), sizes


def least_edits(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """A bound below of the edits between texts, given by their runs and lengths: an edit takes away three runs at most."""
    gone = np.maximum(np.bitwise_count(a & ~b).sum(axis=-1), np.bitwise_count(b & ~a).sum(axis=-1))
    return np.maximum(gone / 3, np.abs(a_size - b_size))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(rk, rh, id, t) -> a row per line that has letters: rk, rh, id, line, h, g (its hash), keys (null: only exact repeats).

    Of equal lines of a batch the first one alone bears the keys.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, line, digests, fresh, full = [], [], [], {}, []
                for i, t in enumerate(batch.column("t").to_pylist()):
                    raw = None
                    for j, w in enumerate(normal_lines(t)):
                        if not w:
                            continue
                        long = len(w) >= min_words
                        if not long:
                            size = letters(w)
                            long = size >= LONG
                            if size < MIN_LETTERS:
                                raw = t.split("\n") if raw is None else raw
                                w = [b"\n", raw[j].strip().encode()]
                        digest = xxhash.xxh3_128_digest(b" ".join(w))
                        row.append(i)
                        line.append(j)
                        if long and digest not in fresh:
                            fresh[digest] = len(digests)
                            full.append(tokens(w, min_words))
                        digests.append(digest)
                if not row:
                    continue
                keys: list[bytes | None] = [None] * len(row)
                for i, k in zip(fresh.values(), band_keys(full), strict=True):
                    keys[i] = k
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("rk", "rh", "id")), pa.array(line, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.binary())],
                    names=["rk", "rh", "id", "line", "h", "g", "keys"],
                )

    return small_batches(docs).mapInArrow(handing_back(work), f"rk long, rh int, id {docs.schema['id'].dataType.simpleString()}, line int, h long, g long, keys binary")


def _spread(lines: DataFrame) -> DataFrame:
    """lines(node, keys) -> key, node: a row for each band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").to_pylist()
            wide = np.zeros((sum(map(len, keys)) // KEY, 8), np.uint8)
            wide[:, :KEY] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
            times = np.fromiter(map(len, keys), np.int64, len(keys)) // KEY
            yield pa.RecordBatch.from_arrays([pa.array(wide.view(np.int64).ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), times))], names=["key", "node"])

    return lines.mapInArrow(handing_back(work), "key long, node long")


def _meetings(lines: DataFrame) -> DataFrame:
    """lines(node, keys) -> key, node: the groups of nodes that share a band; groups of the same nodes share a key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, piece in runs(batches, ["key"], BLOCK):
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            if not piece:  # all of a large group goes on under its own key
                sizes = np.diff(np.append(starts, len(t)))
                own = np.add.reduceat(_mixed(node.view(np.uint64)), starts)
                found = np.repeat(sizes > 1, sizes)
                key, node = np.repeat(own.view(np.int64), sizes)[found], node[found]
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    return _spread(lines).repartition("key").sortWithinPartitions("key").mapInArrow(handing_back(work), "key long, node long")


def centre(bits: np.ndarray) -> int:
    """Which of the texts has most in common with all of them."""
    each = np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1)
    mean = each.mean(axis=0, dtype=np.float32)
    return int((np.where(each, mean, 1 - mean)).sum(axis=1).argmax())


def linked(groups: list[list[str]], least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each large group the links, as places in it, that connect whatever is similar there; what all groups ask for is compared together."""
    going, asked, out = [_linking(texts, least) for texts in groups], {}, [None] * len(groups)

    def step(g: int, good: np.ndarray | None) -> None:
        try:
            asked[g] = going[g].send(good)
        except StopIteration as end:
            out[g] = end.value
            asked.pop(g, None)

    for g in range(len(groups)):
        step(g, None)
    while asked:
        turns = list(asked.items())
        left, right = ([groups[g][x] for g, pair in turns for x in pair[side].tolist()] for side in (0, 1))
        good = similar(left, right, least)
        ends = np.cumsum([len(i) for _, (i, _) in turns])
        for (g, _), some in zip(turns, np.split(good, ends[:-1]), strict=True):
            step(g, some)
    return out


def _linking(texts: list[str], least: float) -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Asks which pairs of places are similar -> links, as places in ``texts``, that connect whatever is similar in a large group.

    First all texts meet up to ``CENTRES`` of them, each the centre of what is left. Then every text outside the largest
    component meets those of other components that the bounds leave, the likeliest first, until it is connected to
    them or none is left: a pair is passed over only where it is connected already or can't be similar.
    """
    n = len(texts)
    bits, sizes = grams(texts)
    own, links = Forest(n), []

    def test(i: np.ndarray, j: np.ndarray) -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray, None]:
        if not len(i):
            return
        good = yield i, j
        for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
            if own.join(x, y):
                links.append((x, y))

    left = np.arange(n)
    for _ in range(CENTRES):
        if len(left) < 2:
            break
        at = left[centre(bits[left])]
        left = left[left != at]
        may = left[least_edits(bits[left], bits[at : at + 1], sizes[left], sizes[at]) <= allowed(np.maximum(sizes[left], sizes[at]), least)]
        yield from test(np.full(len(may), at), may)
        left = left[[own.root(x) != own.root(at) for x in left.tolist()]]
    comp = np.array([own.root(x) for x in range(n)])
    rest = np.flatnonzero(comp != np.bincount(comp).argmax())
    turn = np.full(n, n)
    turn[rest] = np.arange(len(rest))
    for lo in range(0, len(rest), 32):
        some = rest[lo : lo + 32]
        bound, most = least_edits(bits[some][:, None], bits[None], sizes[some][:, None], sizes[None]), allowed(np.maximum(sizes[some][:, None], sizes[None]), least)
        row, j = np.nonzero((bound <= most) & (comp[some][:, None] != comp) & (turn > turn[some][:, None]))
        order = np.lexsort((bound[row, j] / most[row, j], row))
        i, j, take = some[row[order]], j[order], 3
        while len(i):  # a few of each text at first, then twice as many each time
            place = np.arange(len(i)) - np.searchsorted(i_turn := turn[i], i_turn)
            now, take = place < take, 2 * take
            yield from test(i[now], j[now])
            comp = np.array([own.root(x) for x in range(n)])
            open_ = ~now & (comp[i] != comp[j])
            i, j = i[open_], j[open_]
    a, b = zip(*links, strict=True) if links else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def group_links(texts: list[str], starts: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of groups of any size, those of up to ``LARGE`` texts in one way, larger ones in another; each way takes all its groups together."""
    links, flat, begin, large = [], [], [], []
    for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):
        if hi - lo > LARGE:
            large.append((lo, hi))
        else:
            begin.append(len(flat))
            flat.extend(range(lo, hi))
    found = linked([texts[lo:hi] for lo, hi in large], least)
    links.extend((a + lo, b + lo) for (lo, _), (a, b) in zip(large, found, strict=True))
    if flat:
        back = np.array(flat)
        links.append(tuple(back[x] for x in forest([texts[x] for x in flat], begin, least)))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(y) for y in (zip(*links, strict=True) if links else ((), ()))))


def forest(texts: list[str], starts: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places in ``texts``, that connect in each group what is similar there.

    In each group a text meets all the others; what it reaches meets in turn what has not been reached yet, until
    nothing new comes, and then the next one not reached begins again. What is known of the distances from where it
    began spares comparisons: no two texts are nearer to each other than their distances from a third one differ.
    """
    bits, sizes = grams(texts)
    ends = [*starts[1:], len(texts)]
    fresh = np.ones(len(texts), bool)
    low, high = np.zeros(len(texts)), np.full(len(texts), np.inf)  # of the distance from the text that began
    begin, queue, a, b = list(starts), [[] for _ in starts], [], []
    going = [g for g, (lo, hi) in enumerate(zip(starts, ends, strict=True)) if hi - lo > 1]
    while going:
        left, right, root, after, pairs = [], [], [], [], 0
        for g in going:
            first = not queue[g]
            while not queue[g] and begin[g] < ends[g]:
                if fresh[begin[g]]:
                    fresh[begin[g]] = False
                    queue[g].append(begin[g])
                begin[g] += 1
            rest = np.flatnonzero(fresh[starts[g] : ends[g]]) + starts[g]
            if not len(rest):
                continue
            many = 1 if first or pairs > 8 * TOGETHER else max(1, TOGETHER // len(rest))
            some, queue[g] = queue[g][-many:], queue[g][:-many]
            pairs += len(some) * len(rest)
            for x in some:
                left.append(np.full(len(rest), x))
                right.append(rest)
                root.append(np.full(len(rest), first))
            after.append(g)
        if not left:
            break
        i, j, root = np.concatenate(left), np.concatenate(right), np.concatenate(root)
        most = allowed(np.maximum(sizes[i], sizes[j]), least)
        at_least = least_edits(bits[i], bits[j], sizes[i], sizes[j])
        with np.errstate(invalid="ignore"):
            apart = np.where(root, 0.0, np.fmax(low[j] - high[i], low[i] - high[j]))
        test = np.flatnonzero((at_least <= most) & (apart <= most))
        low_, high_ = bounded([texts[x] for x in i[test]], [texts[x] for x in j[test]], least)
        new = root.copy()
        low[j[new]], high[j[new]] = at_least[new], np.inf
        known = root[test]
        low[j[test][known]], high[j[test][known]] = np.maximum(low_[known], low[j[test][known]]), high_[known]
        low[i[root]], high[i[root]] = 0.0, 0.0
        found = test[high_ <= most[test]]
        found = found[np.unique(j[found], return_index=True)[1]]  # one link each
        fresh[j[found]] = False
        place = np.searchsorted(starts, j[found], side="right") - 1
        for g, x in zip(place.tolist(), j[found].tolist(), strict=True):
            queue[g].append(x)
        a.append(i[found])
        b.append(j[found])
        going = after
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))


def _links(members: DataFrame, least: float, rows: int) -> DataFrame:
    """members(key, b1, b2, node, text) -> links (a, b) that connect each group's similar lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, n = [], [], 0

        def linked() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            node = t.column("node").to_numpy()
            a, b = group_links(t.column("text").to_pylist(), starts, least)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for t, own, _ in runs(batches, ["key", "b1", "b2"]):
            held.append(t.select(["node", "text"]))
            starts.extend((own + n).tolist())
            n += len(t)
            if n >= MEMBERS:
                yield linked()
                held, starts, n = [], [], 0
        if n:
            yield linked()

    # comparing is dear for the bytes of a row, so the partitions go by rows
    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // MEMBERS_A_TASK)
    return members.repartition(n, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(handing_back(work), "a long, b long")


def _to_documents(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Join the written per-document lists by rk and rh: broadcast if small, else by shuffling, built on the lists."""
    small = lists.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] <= BROADCAST_BYTES
    lists = lists.drop("bytes")
    return docs.join(F.broadcast(lists) if small else lists.hint("shuffle_hash"), ["rk", "rh"], how)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(rk, rh, line, node) -> node, text: the normalised lines, cut from the documents."""
    lists = wanted.groupBy("rk", "rh").agg(F.collect_list(F.struct("line", "node")).alias("want"), (F.count("*") * 16 + 40).alias("bytes"))
    given = _to_documents(docs.select("rk", "rh", "t"), written(lists, "wanted-lines"), "inner")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, text = [], []
            for t, want in zip(batch.column("t").to_pylist(), batch.column("want").to_pylist(), strict=True):
                lines = t.split("\n")
                for w in want:
                    node.append(w["node"])
                    text.append(b" ".join(normal_lines(lines[w["line"]])[0]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(text, pa.string())], names=["node", "text"])

    return small_batches(given).mapInArrow(handing_back(work), "node long, text string").dropDuplicates(["node"])


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs(rk, rh, id, t), a row or equal rows per (rk, rh) -> the lines that go: rk, rh, line, kept_in."""
    lines = written(_lines(docs, min_words), "lines")
    place = F.struct("id", "rk", "rh", "line")
    distinct = lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("keys").alias("keys"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-lines")
    met = written(_meetings(distinct.where("keys is not null").select("node", "keys")).distinct(), "meetings")
    active = met.select("node").distinct()
    wanted = distinct.select("node", "first.rk", "first.rh", "first.line").join(active.hint("shuffle_merge"), "node")
    text = written(_texts(docs, wanted), "near-texts")
    dealt = block_pairs(met, "key", F.xxhash64("node"))
    comps = written(components(_links(dealt.join(text.hint("shuffle_merge"), "node"), least, met.count())), "line-groups")
    # every line that is not alone, with the first occurrence of its group
    mine = distinct.select("h", "g", "node", "first", "n").join(comps.hint("shuffle_merge"), "node", "left").where("n > 1 or component is not null")
    mine = written(mine.select("h", "g", "first", F.coalesce("component", "node").alias("group")), "line-members")
    stays = written(mine.groupBy("group").agg(F.min("first").alias("stay")), "lines-that-stay")
    rule = mine.join(stays.hint("shuffle_merge"), "group").select("h", "g", "stay")
    found = lines.drop("keys", "id").join(written(rule, "line-rules").hint("shuffle_merge"), ["h", "g"])
    other = (F.col("rk") != F.col("stay.rk")) | (F.col("rh") != F.col("stay.rh")) | (F.col("line") != F.col("stay.line"))
    return found.where(other).select("rk", "rh", "line", F.col("stay.id").alias("kept_in"))


def row_key(key: str, text: str) -> list:
    """Two hashes of a row's key and text, as rk and rh."""
    both = (F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    return [F.xxhash64(*both).alias("rk"), F.hash(*both).alias("rh")]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents that have a text: rk, rh, id, t."""
    return docs.where(F.col(f"`{text}`").isNotNull()).select(*row_key(key, text), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text``; all rows stay.

    New columns: ``lines_removed``, and ``kept_in``, the keys of the documents in which the removed lines' groups stay.
    """
    gone = duplicate_lines(keyed(docs, key, text), min_words, least)
    lists = gone.groupBy("rk", "rh").agg(F.collect_set("line").alias("gone"), F.sort_array(F.collect_set("kept_in")).alias("kept_in"))
    size = 60 + 4 * F.size("gone") + F.length(F.array_join(F.col("kept_in").cast("array<string>"), ","))
    lists = written(lists.select("rk", "rh", F.struct("gone", "kept_in").alias("__gone"), size.cast("long").alias("bytes")), "lines-gone")
    columns = [c for c in docs.columns if c not in ("lines_removed", "kept_in")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), *row_key(key, text))
    marked = _to_documents(rows, lists, "left")
    old, out = F.col(f"__row.`{text}`"), F.col("__gone.gone")
    stay = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), out), lambda i: F.get(parts, i))
    kept = F.get(F.transform(F.array(F.split(old, "\n")), lambda parts: F.array_join(stay(parts), "\n")), F.lit(0))  # split once
    return marked.select(
        *(F.when(out.isNull(), old).otherwise(kept).alias(c) if c == text else F.col(f"__row.`{c}`") for c in columns),
        F.coalesce(F.size(out), F.lit(0)).cast("long").alias("lines_removed"),
        F.coalesce(F.col("__gone.kept_in"), F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")).alias("kept_in"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went and in which documents they stay, and the digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    left = dedup_lines(docs.withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("long")))
    return left.select("doc_id", "n_lines", "lines_removed", "kept_in", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
