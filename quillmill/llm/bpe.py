r"""Byte-level BPE: exact linear-time encoding by backtracking, decoding by an offset table.

Encoding of one pre-token: a walk down a tree of the vocabulary, from all places at a time, gives the longest token at
each place. Going left to right, a longest match is accepted if it may follow the token before
it; otherwise shorter prefixes are tried, and if none fits, the token before is taken back. Two tokens may stand side
by side if merging their concatenation does not cross the border, which a walk over the pair table and the table of
last merges decides. Places once found to be dead ends are never entered again, so the work is linear. The pre-tokens
of many texts go this way together, one step of all of them at a time, and those seen before are remembered.

Decoding: all token bytes lie in one buffer, ``offsets[i]`` is where token i begins; a run of ids is decoded by one
gather from the buffer.

Defined cases: null text is encoded like the empty text: no ids; a special token's string inside a text becomes its id,
as the tokenizers library does; other columns are ignored, so clashing names do no harm; every row is kept, repeated
ones too.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import handing_back, small_batches, table

#: Pieces of text a Python worker remembers, in two generations of this many; longer pieces are not remembered.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48
#: Pairs of tokens whose compatibility a worker remembers, as a power of two.
MEMO_PAIRS = 20
#: Bytes of text that a worker encodes together.
SLICE_BYTES = 500_000
#: Pieces between which no token can reach over: white space begins one, as does a blank before other characters.
_WS = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Tables of one byte-level BPE vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pattern = regex.compile(pattern)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # internal numbers in merge order: single bytes first, then merge results
        made = [a + b for a, b in merges]
        order = [s for s in vocab if len(s) == 1] + made
        self.public = np.array([vocab[s] for s in order], np.int32)
        latin = str.maketrans({c: chr(b) for c, b in symbols.items()})  # a token's bytes, each as one character
        order = [s.translate(latin) for s in order]
        merges = [(a.translate(latin), b.translate(latin)) for a, b in merges]
        rank = {s: i for i, s in enumerate(order)}
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            i = rank[a + b]
            self.left[i], self.right[i] = rank[a], rank[b]
            self.pairs[rank[a], rank[b]] = i
        self._tree(rank)
        self.size = np.array([len(s) for s in order])
        self.byte = np.array([rank[chr(b)] for b in range(256)])
        trie = ahocorasick.Automaton()
        self.shorter = np.full(len(order), -1)  # the longest proper prefix that is a token
        for s, i in sorted(rank.items(), key=lambda x: len(x[0])):
            n = trie.longest_prefix(s[:-1]) if i and len(s) > 1 else 0
            while n and s[:n] not in rank:
                n -= 1
            self.shorter[i] = rank[s[:n]] if n else -1
            trie.add_word(s, i)
        # decoding: one buffer of all tokens' bytes by public id
        pieces = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        n = max(pieces) + 1
        lengths = np.zeros(n + 1, np.int64)
        for i, x in pieces.items():
            lengths[i + 1] = len(x)
        self.offsets = np.cumsum(lengths)
        self.buffer = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(n)), np.uint8)
        self.decimal = [str(i) for i in range(n)]
        self.pair_of = np.full(1 << MEMO_PAIRS, -1)
        self.pair_fits = np.zeros(1 << MEMO_PAIRS, bool)
        self.forget()

    def forget(self) -> None:
        """Pieces go; the pairs stay, as they take the same room whatever was read."""
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _tree(self, rank: dict[str, int]) -> None:
        """The tokens as a tree of bytes: a table of all first two bytes, then (node, byte) -> node in a table of hashes."""
        node: dict[str, int] = {}
        for s in rank:
            for n in range(2, len(s) + 1):
                node.setdefault(s[:n], len(node))
        self.token_at = np.array([rank.get(s, -1) for s in node])
        self.first_two = np.full(1 << 16, -1)
        edges = []
        for s, i in node.items():
            if len(s) == 2:
                self.first_two[ord(s[0]) << 8 | ord(s[1])] = i
            else:
                edges.append((node[s[:-1]] << 8 | ord(s[-1]), i))
        code, child = np.array(edges).reshape(-1, 2).T
        bits = int(8 * max(len(code), 1)).bit_length()
        self.shift, self.edge, self.child = np.uint64(64 - bits), np.full(1 << bits, -1), np.full(1 << bits, -1)
        slot = self._slot(code)
        while len(code):  # one of those that want a slot gets it, the others try the next one
            free = self.edge[slot] < 0
            self.edge[slot[free]], self.child[slot[free]] = code[free], child[free]
            left = self.edge[slot] != code
            self.child[slot[~left]] = child[~left]
            code, child, slot = code[left], child[left], slot[left] + 1 & (1 << bits) - 1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def longest(self, raw: np.ndarray) -> np.ndarray:
        """The longest token that begins at each byte; all places go down the tree at once."""
        out = self.byte[raw]
        if len(raw) < 2:
            return out
        wide = raw.astype(np.int64)
        node = self.first_two[wide[:-1] << 8 | wide[1:]]
        at, n = np.flatnonzero(node >= 0), 2
        node = node[at]
        while len(at):
            token = self.token_at[node]
            ends = token >= 0
            out[at[ends]] = token[ends]
            more = at + n < len(raw)
            if not more[-1]:
                at, node = at[more], node[more]
            code = node << 8 | wide[at + n]
            slot = self._slot(code)
            found = self.edge[slot]
            off = np.flatnonzero((found != code) & (found >= 0))
            while len(off):
                slot[off] = slot[off] + 1 & len(self.edge) - 1
                found[off] = self.edge[slot[off]]
                off = off[(found[off] != code[off]) & (found[off] >= 0)]
            go = np.flatnonzero(found == code)
            at, node, n = at[go], self.child[slot[go]], n + 1
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE, given the bytes of token a followed by those of b, ends with exactly these two tokens."""
        pairs, left, right, limit = self.pairs, self.left, self.right, 1 << 60
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs; a table remembers one pair in each place."""
        pair = a << 20 | b
        at = pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MEMO_PAIRS)
        at = at.view(np.int64)
        new = self.pair_of[at] != pair
        if not new.any():
            return self.pair_fits[at]
        fits = self.pair_fits[at]
        fresh, where = np.unique(pair[new], return_inverse=True)
        found = np.array([self.compatible(p >> 20, p & 0xFFFFF) for p in fresh.tolist()])
        fits[new] = found[where]
        self.pair_of[at[new]] = pair[new]
        self.pair_fits[at[new]] = fits[new]
        return fits

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens -> their public ids in a row, and where in it each word ends; all words go forward and back at once."""
        s = "\udcff".join(words).encode("utf-8", "surrogateescape") + b"\xff"
        raw = np.frombuffer(s, np.uint8)
        longest = np.append(self.longest(raw), 0)
        stop = np.flatnonzero(raw == 255)
        pos = np.append(0, stop[:-1] + 1)
        begin, alive = pos.copy(), np.ones(len(raw) + 1, bool)
        before = np.full(len(raw) + 1, -1)  # the token that ends at a place, on the way of the word it lies in
        size, shorter = self.size, self.shorter
        going = np.flatnonzero(pos < stop)
        at, token = pos[going], longest[pos[going]]
        while len(going):
            end = at + size[token]
            last = before[at]
            ok = alive[end]
            ask = np.flatnonzero(ok & (last >= 0))
            ok[ask] = self.fit(last[ask], token[ask])
            less = shorter[token]
            back = ~ok & (less < 0)  # a dead end: take the last token back and go on with its next shorter prefix
            alive[at[back]] = False
            before[end[ok]] = token[ok]
            token = np.where(ok, longest[end], np.where(back, last, less))
            at = np.where(ok, end, np.where(back, at - size[last], at))
            open_ = at < stop[going]
            going, at, token = going[open_], at[open_], token[open_]
        # the ways, from the ends of the words to their beginnings
        going = np.flatnonzero(begin < stop)
        at, on_way = stop[going], np.zeros(len(raw) + 1, bool)
        while len(going):
            on_way[at] = True
            at = at - size[before[at]]
            open_ = at > begin[going]
            going, at = going[open_], at[open_]
        ends = np.flatnonzero(on_way)
        return self.public[before[ends]], np.searchsorted(ends, stop, side="right")

    def encode_word(self, word: str) -> list[int]:
        """Public ids of one pre-token, given as text."""
        return self.encode_words([word])[0].tolist()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Pieces that are not remembered -> their ids as bytes of 32-bit integers."""
        plain = [p for p in pieces if p[1:].isalpha() and p[0] == " "]  # what the pattern would find anyway
        rest = list(pieces.difference(plain))
        ended = [p for p in rest if p[-1] in ".," and p[0] == " " and p[1:-1].isalpha()]
        other = list(set(rest).difference(ended))
        found = list(map(self.pattern.findall, other))
        words = [*plain, *chain.from_iterable((p[:-1], p[-1]) for p in ended), *chain.from_iterable(found)]
        upto = np.cumsum([0] + [1] * len(plain) + [2] * len(ended) + list(map(len, found)))
        pieces = [*plain, *ended, *other]
        if not words:
            return {p: b"" for p in pieces}
        ids, ends = self.encode_words(words)
        whole, cut = ids.tobytes(), (4 * np.append(0, ends)[upto]).tolist()
        return {p: whole[lo:hi] for p, lo, hi in zip(pieces, cut, cut[1:], strict=False)}

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, together: what is not remembered is encoded once for all of them."""
        split, special = self.special_split, self.special
        parts = [[p if p in special else _PIECE.findall(p) for p in (split.split(t or "") if split else [t or ""])] for t in texts]
        unknown = set().union(*(x for some in parts for x in some if not isinstance(x, str))).difference(self.memo)
        new = {p: self.older[p] for p in unknown & self.older.keys()}
        new |= self.learn(unknown.difference(new))
        self.memo |= new
        out, get = [], self.memo.__getitem__
        for some in parts:
            runs = chain.from_iterable([array("i", [special[x]]).tobytes()] if isinstance(x, str) else map(get, x) for x in some)
            out.append(np.frombuffer(b"".join(runs), np.int32))
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.memo[p]
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        """The ids of a text, and the same in decimal with commas."""
        ids = self.encode_all([text])[0]
        return ids, self.in_decimal(ids)

    def in_decimal(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        at = np.repeat(starts - before, lengths) + np.arange(total)
        return self.buffer[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def few_chars(whole: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold one row or about ``limit`` bytes of text at most."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False)) if whole.num_rows else []
    lo = 0
    while lo < whole.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit)))
        yield whole.slice(lo, hi - lo)
        lo = hi


_KINDS = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32()))}


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """-> key, ``ids`` array<int>. ``tokenizer``: path of the vocabulary file, readable on every executor."""
    return _run(docs, tokenizer, key, text, ["ids"])


def token_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """-> key, n_tokens, ids_sha256, decoded_sha256: what came out of encoding and of decoding the ids again."""
    return _run(docs, tokenizer, key, text, ["n_tokens", "ids_sha256", "decoded_sha256"])


def encoded_with_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _run(docs, tokenizer, key, text, ["n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def _run(docs: DataFrame, tokenizer: str, key: str, text: str, names: list[str]) -> DataFrame:
    pair = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for whole in batches:
            for batch in few_chars(whole, "t"):
                runs, digests, decoded = bpe.encode_all(batch.column("t").to_pylist()), [], []
                n = [len(ids) for ids in runs]
                if "ids_sha256" in names:
                    digests = [hashlib.sha256(bpe.in_decimal(ids).encode()).hexdigest() for ids in runs]
                if "decoded_sha256" in names:
                    decoded = [hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in runs]
                made = {"n_tokens": n, "ids_sha256": digests, "decoded_sha256": decoded}
                if "ids" in names:
                    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    made["ids"] = pa.ListArray.from_arrays(ends, np.concatenate(runs) if runs else np.empty(0, np.int32))
                columns = [made[x] if x == "ids" else pa.array(made[x], _KINDS[x][1]) for x in names]
                yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], names=["k", *names])
        bpe.forget()  # the worker goes on to other tasks

    kind = pair.schema["k"].dataType.simpleString()
    return small_batches(pair).mapInArrow(handing_back(work), f"k {kind}, " + ", ".join(f"{x} {_KINDS[x][0]}" for x in names)).withColumnRenamed("k", key)


def decode_documents(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, array<int> -> key, ``text``; null ids give the empty text."""
    pair = encoded.select(F.col(key).alias("k"), F.col(ids).alias("i"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("i")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], names=["k", "text"])

    kind = pair.schema["k"].dataType.simpleString()
    return pair.mapInArrow(work, f"k {kind}, text string").withColumnRenamed("k", key)


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), TOKENIZER)
