"""BPE encoding and decoding with a given vocabulary of the word-end kind, exactly as its library does.

Frequent words of the corpus are compiled, with their ids, into a minimal acyclic automaton: words
that end alike share states, counts on the arcs number the words, and the number selects the ids.
Workers memory-map it. Words it doesn't hold are merged exactly, by rank.

Edge cases: a null or empty text has no ids and decodes to ''; special tokens' strings in a text are
those tokens, as in the library; white space is dropped; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from . import shared, word_counts

#: Words with at least this share of the corpus enter the lexicon, so it holds 1/LEAST_SHARE words at most.
LEAST_SHARE = 5e-6
CACHE_WORDS = 200_000
#: Pieces of more bytes are merged one by one, over a heap.
LONG_PIECE = 64
NO_MERGE = 1 << 60


#: Letters and numbers of Unicode 17 and 18, which the library (Unicode 16) takes for marks.
LATER = "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
_LATER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split()) + "]")


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if it is visible Latin-1, else the next one from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class WordBpe:
    """The vocabulary, merge ranks and splitting rules of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.raw = {i: t.encode() for i, t in self.tokens.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = rank << 20 | self.ids[a + b]
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.int64((1 << 63) - 1))
        self.ranks = np.append(np.array(list(self.merges.values()), np.int64)[order], NO_MERGE)
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pieces = pieces.replace(r"[^\s", f"[^{space}")
        self.piece = regex.compile(pieces + "|\n")
        self.ascii_piece = re.compile(pieces.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9") + "|\n")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.first = np.array([self.ids[c] for c in alphabet], np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in alphabet], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank << 20 | merged id of each pair of ids, NO_MERGE if there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_MERGE)

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece as 32-bit integers: bytes, then always the adjacent pair of the lowest rank, leftmost first.

        Pieces of one length are merged together: each step takes one pair from every piece that has any left, so the
        rows of the matrix stay of one length.
        """
        out: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for p in pieces:
            by_size.setdefault(len(p) if p.isascii() else len(p.encode()), []).append(p)
        for size, names in by_size.items():
            text = np.frombuffer("".join(names).encode(), np.uint8).reshape(len(names), size)
            ids = np.concatenate([self.first[text[:, :-1]], self.last[text[:, -1:]]], 1)
            if size > LONG_PIECE:
                for p, row in zip(names, ids.tolist(), strict=True):
                    out[p] = np.array(self._merge_long(row), "<u4").tobytes()
                continue
            who, rank = np.arange(len(names)), self._rank(ids[:, :-1], ids[:, 1:])
            while len(who):
                width = ids.shape[1]
                best = rank.min(1) if width > 1 else np.full(len(who), NO_MERGE)
                done = best == NO_MERGE
                if done.any():
                    flat = ids[done].astype("<u4").tobytes()
                    for i, k in enumerate(who[done].tolist()):
                        out[names[k]] = flat[4 * width * i : 4 * width * (i + 1)]
                    who, ids, rank, best = who[~done], ids[~done], rank[~done], best[~done]
                    if not len(who):
                        break
                at, row = rank.argmin(1), np.arange(len(who))
                column = np.arange(width - 1)[None, :]
                ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
                ids[row, at] = best & 0xFFFFF
                column = column[:, :-1]
                rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
                before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                rank[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], ids[before, at[before]])
                rank[after, at[after]] = self._rank(ids[after, at[after]], ids[after, at[after] + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for very long pieces: a heap of candidate pairs over a linked list."""
        import heapq

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit, i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.merges[a, b] & 0xFFFFF
            ids[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if hit := self.merges.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (hit, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (hit := self.merges.get((ids[p], ids[i]))):
                heapq.heappush(heap, (hit, p, ids[p], ids[i]))
        return [x for x in ids if x is not None]

    def pieces(self, plain: str) -> list[str]:
        """Runs of letters, single digits and runs of other marks; and line feeds, which keep words apart."""
        if plain.isascii():
            return self.ascii_piece.findall(plain)
        if not _LATER.search(plain):
            return self.piece.findall(plain)
        return [plain[m.start() : m.end()] for m in self.piece.finditer(_LATER.sub("\ufffd", plain))]

    def words(self, raw: list[bytes]) -> list[bytes]:
        """Ids, as 32-bit integers, of each run of bytes without ASCII white space.

        Words are cut into pieces together, apart from those that may hold special tokens; pieces are merged once for all.
        """
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(raw):
            kinds[0 if w.isascii() and b"<|" not in w else 1 if b"<|" not in w else 2].append(i)
        plain = [i for kind in kinds[:2] for i in kind]
        flat: list[str] = []
        for kind in kinds[:2]:
            text = b"\n".join([raw[i] for i in kind]).decode("utf-8", "replace")
            text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
            flat += self.pieces(text.lower())
            flat += ["\n"] if kind else []
        marked: list[list[str]] = []
        for i in kinds[2]:
            cut = self.cut.split(raw[i].decode("utf-8", "replace")) if self.cut else [raw[i].decode("utf-8", "replace")]
            marked.append([x for p in cut for x in ([p] if p in self.special else self.pieces(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()))])
        merged = self.merge([x for x in set(flat).union(*marked) if x != "\n" and x not in self.special])
        merged |= {p: struct.pack("<I", i) for p, i in self.special.items()} | {"\n": b""}
        ids = list(map(merged.__getitem__, flat))
        whole, stop = b"".join(ids), np.cumsum(list(map(len, ids)), dtype=np.int64)
        edge = stop[[i for i, p in enumerate(flat) if p == "\n"]].tolist() if flat else []
        out: list[bytes] = [b""] * len(raw)
        for i, a, z in zip(plain, [0, *edge], edge, strict=False):
            out[i] = whole[a:z]
        for i, pieces in zip(kinds[2], marked, strict=True):
            out[i] = b"".join([merged[x] for x in pieces])
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.words(text.encode("utf-8", "replace").split())), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives without a decoder: tokens set apart by spaces."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


# -- the lexicon ---------------------------------------------------------------------------------


class Lexicon:
    """A minimal acyclic automaton over words; arcs are sorted by (state, byte).

    skip[arc] counts the words of that state that come before those through the arc, so the sum along
    a word's path (plus one for each accepting state that it passes) is the word's rank: a perfect hash.
    """

    def __init__(self, keys: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray, offset: np.ndarray, ids: np.ndarray):
        self.keys, self.target, self.skip, self.final, self.offset, self.ids = keys, target, skip, final, offset, ids
        self.states = len(final)

    @classmethod
    def build(cls, entries: dict[bytes, bytes]) -> Lexicon:
        """From words and their ids as 32-bit integers."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = []
        accept: list[bool] = []
        size: list[int] = []

        def frozen(node: tuple[dict[int, int], list[bool]]) -> int:
            key = (node[1][0], tuple(node[0].items()))
            at = register.get(key)
            if at is None:
                at = register[key] = len(arcs)
                arcs.append(node[0])
                accept.append(node[1][0])
                size.append(node[1][0] + sum(size[t] for t in node[0].values()))
            return at

        path: list[tuple[dict[int, int], list[bool]]] = [({}, [False])]
        last = b""
        for w in [*words, None]:
            common = 0
            if w is not None:
                while common < min(len(w), len(last)) and w[common] == last[common]:
                    common += 1
            while len(path) > common + 1:  # states below the common prefix can't change any more
                node = path.pop()
                path[-1][0][last[len(path) - 1]] = frozen(node)
            if w is None:
                break
            for _ in w[common:]:
                path.append(({}, [False]))
            path[-1][1][0] = True
            last = w
        root = frozen(path[0])
        order = [root] + [s for s in range(len(arcs)) if s != root]  # the root is state 0
        number = {s: i for i, s in enumerate(order)}
        keys, target, skip = [], [], []
        for i, s in enumerate(order):
            before = int(accept[s])
            for label, t in sorted(arcs[s].items()):
                keys.append(i * 256 + label)
                target.append(number[t])
                skip.append(before)
                before += size[t]
        offset = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(entries[w]) // 4 for w in words], out=offset[1:])
        ids = np.frombuffer(b"".join([entries[w] for w in words]), "<u4")
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(skip, np.int32), np.array([accept[s] for s in order], np.uint8), offset, ids)

    def dump(self) -> bytes:
        arrays = [np.ascontiguousarray(a) for a in (self.keys, self.target, self.skip, self.final, self.offset, self.ids)]
        head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        return pad(struct.pack("<Q", len(head)) + head) + b"".join(pad(a.tobytes()) for a in arrays)

    @classmethod
    def map(cls, blob: bytes) -> Lexicon:
        """Memory-map the dump, from a file in memory that has no name."""
        with open(os.memfd_create("lexicon"), "w+b") as f:
            f.write(blob)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
        (n,) = struct.unpack("<Q", raw[:8].tobytes())
        at, arrays = 8 + n + (-(8 + n) % 8), []
        for kind, length in json.loads(raw[8 : 8 + n].tobytes()):
            nbytes = np.dtype(kind).itemsize * length
            arrays.append(raw[at : at + nbytes].view(kind))
            at += nbytes + (-nbytes % 8)
        return cls(*arrays)

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't held; all words walk the automaton together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        length = np.fromiter(map(len, words), np.int64, n)
        buf = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        alive, state, total = np.flatnonzero(length > 0), np.zeros(n, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(alive):
            key = state[alive] * 256 + buf[start[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            alive, arc = alive[ok], arc[ok]
            total[alive] += self.skip[arc]
            state[alive] = self.target[arc]
            depth += 1
            ends = length[alive] == depth
            at = alive[ends]
            hit = self.final[state[at]] == 1
            out[at[hit]] = total[at[hit]]
            alive = alive[~ends]
        return out

    def outputs(self, ranks: np.ndarray) -> list[bytes]:
        """The ids of each number, as 32-bit integers."""
        lo, hi = self.offset[ranks].tolist(), self.offset[ranks + 1].tolist()
        return [self.ids[a:z].tobytes() for a, z in zip(lo, hi, strict=True)]


def frequent_words(docs: DataFrame, least_share: float = LEAST_SHARE) -> list[bytes]:
    """Words with at least that share of all words of all texts (lossy counting: 10 % off at most)."""
    totals = word_counts.counts(docs, least_share=least_share / 10)
    whole = totals.agg(F.sum("total")).first()[0] or 0
    rows = totals.where(F.col("n") >= least_share * whole).select("word").collect()
    return [bytes(r.word) for r in rows]


def compile_lexicon(docs: DataFrame, path: str, least_share: float = LEAST_SHARE) -> Lexicon:
    words = frequent_words(docs, least_share)
    return Lexicon.build(dict(zip(words, load(path).words(words), strict=True)))


class Encoder:
    """One worker's view: a bounded cache of words in front of the lexicon and the exact merges."""

    def __init__(self, path: str, blob: bytes):
        self.model, self.lexicon = load(path), Lexicon.map(blob)
        self.known: dict[bytes, bytes] = {}  # ids as 32-bit integers
        self.raw = [self.model.raw.get(i, b"") for i in range(max(self.model.raw) + 1)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; what is new to the cache is looked up and merged at once."""
        words = [t.split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*words) if w not in known]
        rank = self.lexicon.rank(new)
        held = np.flatnonzero(rank >= 0)
        known.update(zip([new[i] for i in held.tolist()], self.lexicon.outputs(rank[held]), strict=True))
        other = [new[i] for i in np.flatnonzero(rank < 0).tolist()]
        known.update(zip(other, self.model.words(other), strict=True))
        return [b"".join([known[w] for w in ws]) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: tokens set apart by spaces."""
        return b" ".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def digest(self, ids: bytes) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids as little-endian 32-bit integers, sha256 of the decoded text."""
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _over_texts(path: str, blob, keep: list[str], schema: pa.Schema, row):
    """A mapInArrow function: row(encoder, ids) for each text, a chunk of texts at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, blob.value)
        for b in tx.slices(batches):
            texts = tx.as_bytes(b.column("text"))
            out = []
            for lo, hi in tx.chunked(texts, 2 << 20):
                out += [row(encoder, ids) for ids in encoder.ids(texts[lo:hi])]
            made = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *made], [*keep, *schema.names])

    return run


def _run(docs: DataFrame, path: str, lexicon: Lexicon, keep: list[str], schema: pa.Schema, ddl: str, row) -> DataFrame:
    blob = docs.sparkSession.sparkContext.broadcast(lexicon.dump())
    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    columns = [*dict.fromkeys([*keep, "text"])]
    return shared.in_arrow(docs.select(*columns), _over_texts(path, blob, keep, schema, row), f"{kept}, {ddl}" if kept else ddl)


def encode(docs: DataFrame, path: str, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The kept columns and `ids`, an array of ints, of every whole text."""
    schema = pa.schema([("ids", pa.list_(pa.int32()))])
    return _run(docs, path, lexicon, keep, schema, "ids array<int>", lambda _, ids: (np.frombuffer(ids, "<i4"),))


def digests(docs: DataFrame, path: str, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _run(docs, path, lexicon, keep, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", Encoder.digest)
