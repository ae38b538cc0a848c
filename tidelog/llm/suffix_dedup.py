"""Exact removal of repeated byte strings across documents, over sparse suffixes.

Every string of `length` bytes holds an anchor: the k bytes with the smallest hash in it. Anchors
depend on the string alone, so two equal strings share an anchor at the same place, and only suffixes
that start at anchors have to be compared.

1. Each task finds the anchors of its whole texts, with a digest of the bytes around each (all strings
   that hold the anchor lie inside them). Repeats of such a neighbourhood in a batch are settled there
   and then, so a group of copies shuffles one row a batch; one row for each distinct neighbourhood is
   shuffled by its anchor's hash.
2. Neighbourhoods seen before are repeats as a whole. Where an anchor has several different ones,
   their suffixes are compared: sampled splitters range-partition them by their leading k bytes, each
   bucket sorts its suffixes (and, reversed, what stands before them) by multikey quicksort, and
   equal strings are those that agree in a longest-common-prefix interval of both orders.
3. A run of more than RUN suffixes with equal leading bytes is dealt over buckets by all its bytes, and sorted and
   compared there like any other; then the buckets' first places of each string are compared across boundaries.
4. Intervals of each document are joined to its text (compressed for the shuffle), merged and cut out.

An anchor's hash and a neighbourhood's digest are 64 bits each and compared together.

Null and empty texts lose nothing; null ids come after all others. Rows with equal ids (or none) but different texts
are told apart, and ordered, by 64 bits of their text's digest (text_tag); exact repeats of a row are one place
and keep each other. Very long texts are read whole; an empty table gives an empty one; other columns, whatever
their names, are not read. One task gathers the neighbourhoods of one anchor to count them; it spills, but isn't split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import text as tx

K = 32
#: Suffixes with the same leading bytes that one bucket takes whole; longer runs lie in several.
RUN = 100_000
#: Ids that occur more than once are known to all tasks by which of so many hash values they have.
ID_BUCKETS = 1 << 16
LAST_ID = (1 << 63) - 1
_MUL = np.uint64(0xD6E8FEB86659FD93)
_BYTE = tx.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_tag(text: bytes) -> int:
    """64 bits that tell texts under one id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def text_tags(b: pa.RecordBatch, texts: list[bytes], shared_id: np.ndarray) -> np.ndarray:
    """The tag of each text whose id may be another row's too (by its hash value), 0 for all others: zeros shuffle cheaply."""
    tags = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(shared_id[b.column("id_bucket").to_numpy()]).tolist():
        tags[i] = text_tag(texts[i])
    return tags


def identified(docs: DataFrame, *columns: str) -> tuple[DataFrame, np.ndarray]:
    """The columns, doc_id (null: LAST_ID) and id_bucket, and which buckets hold an id of several rows."""
    rows = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_doc_id"))
    rows = rows.withColumn("id_bucket", F.pmod(F.xxhash64("_doc_id"), F.lit(ID_BUCKETS)).cast("int"))
    several = rows.groupBy("_doc_id", "id_bucket").count().where("count > 1").select("id_bucket").distinct()
    shared_id = np.zeros(ID_BUCKETS, bool)
    shared_id[[r.id_bucket for r in several.collect()]] = True
    return rows, shared_id


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on (k a power of two), by doubling."""
    h, span, factor = _BYTE[buf], 1, np.array([_MUL])
    while span < k:
        h = h[:-span] * factor + h[span:]
        factor, span = factor * factor, span * 2
    return tx.mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(buf: np.ndarray, at: np.ndarray, size: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of all strings inside the texts at[i]:at[i]+size[i] of the buffer."""
    w = length - k + 1
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(buf, k)
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    packed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(packed, w)
    inside = np.zeros(len(buf) + 1, np.int32)
    ok = size >= length
    np.add.at(inside, at[ok], 1)
    np.add.at(inside, (at + size - length + 1)[ok], -1)
    starts = np.cumsum(inside)[: len(least)] > 0
    places = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    places = np.unique(places)
    return places, h[places]


def _find(length: int, k: int, shared_id: np.ndarray):
    """mapInArrow: neighbourhoods (stop is null) and intervals that are known to repeat."""
    reach = length - k
    schema = pa.schema([("anchor", pa.int64()), ("around", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            texts, ids = tx.as_bytes(b.column("text")), b.column("_doc_id").to_numpy()
            tags = text_tags(b, texts, shared_id)
            for lo, hi in tx.chunked(texts):
                part = texts[lo:hi]
                size = np.fromiter(map(len, part), np.int64, len(part))
                at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
                place, h = anchors(np.frombuffer(b"\n".join(part), np.uint8), at, size, length, k)
                if not len(place):
                    continue
                doc = np.searchsorted(at, place, side="right") - 1
                pos = place - at[doc]
                left = np.maximum(pos - reach, 0)
                right = np.minimum(pos + length, size[doc])
                digest = b"".join([hashlib.blake2b(part[d][a:z], digest_size=8).digest() for d, a, z in zip(doc.tolist(), left.tolist(), right.tolist(), strict=True)])
                # neighbourhoods cut short by their text's start differ in where the anchor lies
                around = tx.mix(np.frombuffer(digest, np.uint64) + (pos - left).astype(np.uint64)).view(np.int64)
                who, tag = ids[lo:hi][doc], tags[lo:hi][doc]
                order = np.lexsort((pos, tag, who, around, h))
                same = np.zeros(len(order), bool)
                same[1:] = (h[order][1:] == h[order][:-1]) & (around[order][1:] == around[order][:-1])
                head = order[~same]
                of = head[(np.cumsum(~same) - 1)[same]]
                again = order[same]
                again = again[(who[again] != who[of]) | (tag[again] != tag[of]) | (pos[again] != pos[of])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[head].view(np.int64)), pa.array(around[head]), pa.array(who[head]), pa.array(tag[head]), pa.array(pos[head].astype(np.int32)), pa.nulls(len(head), pa.int32())], schema=schema
                )
                if len(again):
                    of_doc, a, z = _runs(doc[again], left[again], right[again])
                    d = ids[lo:hi][of_doc]
                    spread = tx.mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(spread), pa.array(d), pa.array(tags[lo:hi][of_doc]), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], schema=schema)

    return run


# -- suffixes of one bucket ------------------------------------------------------------------------


def multikey_sort(words: np.ndarray, rows: np.ndarray | None = None, depth: int = 0) -> np.ndarray:
    """Order of the rows of a (n, m) matrix of 8-byte big-endian keys, by multikey quicksort.

    Rows are split into those below, at and above a pivot key; those at it go on with the next key.
    """
    rows = np.arange(len(words)) if rows is None else rows
    out: list[np.ndarray] = []
    stack = [(rows, depth)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            out.append(rows)
            continue
        key = words[rows, depth]
        if len(rows) <= 4096:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
            continue
        pivot = np.partition(key[:: max(1, len(key) // 127)], 0 if len(key) < 3 else len(key[:: max(1, len(key) // 127)]) // 2)
        pivot = pivot[len(pivot) // 2]
        stack += [(rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)]
    return np.concatenate(out) if out else rows


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded rows of `width` bytes as big-endian keys, and their lengths."""
    width8 = -(-width // 8) * 8
    raw = np.frombuffer(b"".join([p[:width].ljust(width8, b"\0") for p in parts]), np.uint8).reshape(len(parts), width8)
    return raw.view(">u8").astype(np.uint64), raw


def _common(raw: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each row with the one before it in the order; the first has 0."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = raw[order[1:]], raw[order[:-1]]
        differ = a != b
        first = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]]))
    return out


Strings = tuple[np.ndarray, np.ndarray]


def earlier(left: list[bytes], right: list[bytes], place: np.ndarray, length: int, k: int) -> tuple[Strings, Strings]:
    """(row, i) of each string of i bytes of left[row] and length-i of right[row] that a smaller place holds too.

    left is what stands before the anchor, right starts with it; place orders the rows. The second pair of arrays has
    the first place of each different string.
    """
    rmat, rraw = _matrix(right, length)
    lmat, lraw = _matrix([x[::-1] for x in left], length - k)
    rsize = np.fromiter(map(len, right), np.int64, len(right))
    lsize = np.fromiter(map(len, left), np.int64, len(left))
    by_r, by_l = multikey_sort(rmat), multikey_sort(lmat)
    lcp_r, lcp_l = _common(rraw, by_r, rsize), _common(lraw, by_l, lsize)
    n = len(place)
    rows, cuts, firsts, first_cuts = [], [], [], []
    _, rank = np.unique(place, return_inverse=True)
    group_r, group_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(length - k + 1):
        has = (lsize >= i) & (rsize >= length - i)
        if not has.any():
            continue
        group_r[by_r] = np.cumsum(lcp_r < length - i)
        group_l[by_l] = np.cumsum(lcp_l < i) if i else 0
        at = np.flatnonzero(has)
        key = group_r[at] * (n + 1) + group_l[at]
        order = np.lexsort((rank[at], key))
        key, at = key[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head = rank[at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]]
        late = at[rank[at] > head]
        rows.append(late)
        cuts.append(np.full(len(late), i))
        firsts.append(at[new])
        first_cuts.append(np.full(int(new.sum()), i))
    if not rows:
        return (np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2
    return (np.concatenate(rows), np.concatenate(cuts)), (np.concatenate(firsts), np.concatenate(first_cuts))


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [start, stop) for each doc."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    code = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    far = np.maximum.accumulate(stop + code * (1 << 40))  # docs lie apart, so the largest stop so far is the own doc's
    new = np.ones(len(doc), bool)
    new[1:] = (start + code * (1 << 40))[1:] > far[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], far[tail] - code[tail] * (1 << 40)


_SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("stop", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
_SPAN = "doc_id long, tag long, pos int, stop int, w1 long, w2 long"


def _compare(length: int, k: int, cut_runs: bool, most: int = 60_000):
    """mapInArrow over a range partition that is sorted by the leading bytes: repeated intervals.

    Some ten thousand suffixes are settled at a time. Runs of equal leading bytes are taken together, unless cut_runs:
    then the first place of each string goes out too (stop is null), to be compared across boundaries.
    """

    def settle(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(rows)
        doc, tag, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "tag", "pos"))
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        order = np.lexsort((pos, tag, doc))
        new_doc, new_place = np.zeros((2, len(doc)), bool)
        new_doc[1:] = (doc[order][1:] != doc[order][:-1]) | (tag[order][1:] != tag[order][:-1])
        new_place[1:] = new_doc[1:] | (pos[order][1:] != pos[order][:-1])
        number, place = np.empty((2, len(doc)), np.int64)
        number[order], place[order] = np.cumsum(new_doc), np.cumsum(new_place)
        (row, i), (first, j) = earlier(left, right, place, length, k)
        d, a, z = _runs(number[row], pos[row] - i, pos[row] - i + length)
        of = order[np.searchsorted(np.cumsum(new_doc), d)]
        none = pa.nulls(len(of), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(tag[of]), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), none, none], schema=_SPANS)
        for lo in range(0, len(first) if cut_runs else 0, 100_000):
            r, c = first[lo : lo + 100_000], j[lo : lo + 100_000]
            strings = [(left[x][len(left[x]) - y :] if y else b"") + right[x][: length - y] for x, y in zip(r.tolist(), c.tolist(), strict=True)]
            w = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in strings]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tag[r]), pa.array((pos[r] - c).astype(np.int32)), pa.nulls(len(r), pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1])], schema=_SPANS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for b in tx.slices(batches, 10_000):
            t = pa.Table.from_batches([b])
            if count + len(t) > most and count:
                cut = 0
                if not cut_runs:  # where the leading bytes change
                    head, last = [x[:k] for x in t.column("right").to_pylist()], held[-1].column("right")[-1].as_py()[:k]
                    while cut < len(head) and head[cut] == last:
                        cut += 1
                if cut < len(t):
                    yield from settle([*held, t.slice(0, cut)])
                    held, count, t = [], 0, t.slice(cut)
            held.append(t)
            count += len(t)
        if held:
            yield from settle(held)

    return run


def _pack(keep: list[str], shared_id: np.ndarray):
    """mapInArrow: the kept columns and the compressed text with its size and tag."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in tx.slices(batches):
            texts = tx.as_bytes(b.column("text"))
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), packed, pa.array([len(t) for t in texts], pa.int64()), pa.array(text_tags(b, texts, shared_id))], [*keep, "_packed", "_size", "_tag"])

    return run


def _unpack(b: pa.RecordBatch) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(t, n, asbytes=True) for t, n in zip(b.column("_packed").to_pylist(), b.column("_size").to_pylist(), strict=True)]


def packed(rows: DataFrame, shared_id: np.ndarray) -> DataFrame:
    """The identified rows with their text compressed, so that a shuffle of whole texts writes about half, and _tag."""
    keep = [c for c in rows.columns if c not in ("text", "id_bucket")]
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return shared.in_arrow(rows, _pack(keep, shared_id), f"{kept}, _packed binary, _size long, _tag long")


def _around(length: int, k: int):
    """mapInArrow: for each (text, positions, long flags) the bytes before and from each anchor on; long: its run is longer than RUN."""
    reach = length - k
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("long", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            texts, ids, tags, spots = _unpack(b), b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("spots").to_pylist()
            doc, tag, pos, long, left, right = [], [], [], [], [], []
            for t, d, g, s in zip(texts, ids, tags, spots, strict=True):
                for x in s:
                    p = x["pos"]
                    doc.append(d)
                    tag.append(g)
                    pos.append(p)
                    long.append(x["long"])
                    left.append(t[max(0, p - reach) : p])
                    right.append(t[p : p + length])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(pos, pa.int32()), pa.array(long, pa.bool_()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=schema)

    return run


def spans(rows: DataFrame, shared_id: np.ndarray, length: int = 100, k: int = K) -> DataFrame:
    """(doc_id, tag, pos, stop) intervals of identified rows to cut out; together they cover what repeats."""
    rows = rows.select("_doc_id", "id_bucket", "text").where(F.octet_length("text") >= length)
    found = shared.in_arrow(rows, _find(length, k, shared_id), "anchor long, around long, doc_id long, tag long, pos int, stop int")
    own = Window.partitionBy("anchor")
    found = found.withColumn("n", F.count(F.when(F.col("stop").isNull(), 1)).over(own)).where("n > 1 OR stop IS NOT NULL")
    found = shared.saved(found.select("anchor", "around", "doc_id", "tag", "pos", "stop"))
    settled = found.where("stop IS NOT NULL").select("doc_id", "tag", "pos", "stop")
    hood = found.where("stop IS NULL").drop("stop")
    place = F.struct("doc_id", "tag", "pos")
    firsts = shared.saved(hood.groupBy("anchor", "around").agg(F.min(place).alias("first")))
    # a neighbourhood that stood earlier: all strings around the anchor repeat
    late = hood.join(firsts, ["anchor", "around"]).where(place > F.col("first"))
    late = late.select("doc_id", "tag", F.greatest(F.lit(0), F.col("pos") - (length - k)).alias("pos"), (F.col("pos") + length).alias("stop"))
    several = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = firsts.join(several, "anchor").select("first.*", (F.col("kinds") > RUN).alias("long"))
    spots = open_.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "long")).alias("spots"))
    texts = packed(rows, shared_id).withColumnsRenamed({"_doc_id": "doc_id", "_tag": "tag"}).join(spots, ["doc_id", "tag"])
    around = shared.saved(shared.in_arrow(texts, _around(length, k), "doc_id long, tag long, pos int, long boolean, left binary, right binary"))
    head = F.substring("right", 1, k)
    whole = around.where(~F.col("long")).repartitionByRange(head).sortWithinPartitions(head)
    repeats = shared.in_arrow(whole, _compare(length, k, False), _SPAN).select("doc_id", "tag", "pos", "stop")
    # long runs: no two neighbourhoods of an anchor are alike, so splitters fall inside a run
    every = [F.col("right"), F.col("left")]
    dealt = around.where("long").repartitionByRange(*every).sortWithinPartitions(*every)
    cut = shared.saved(shared.in_arrow(dealt, _compare(length, k, True), _SPAN))
    strings = cut.where("stop IS NULL").drop("stop")
    least = strings.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = strings.join(least, ["w1", "w2"]).where(place > F.col("first")).select("doc_id", "tag", "pos", (F.col("pos") + length).alias("stop"))
    return settled.unionByName(late).unionByName(repeats).unionByName(cut.where("stop IS NOT NULL").select("doc_id", "tag", "pos", "stop")).unionByName(across)


def merge_spans(spots: list[dict], size: int) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((max(0, s["pos"]), min(size, s["stop"])) for s in spots):
        if a >= z:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


#: What dedup can return of the remaining bytes: column, types, and how it is made.
RESULTS = {
    "sha256": ("kept_sha256", "string", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest()),
    "bytes": ("kept", "binary", pa.binary(), lambda kept: kept),
    "text": ("kept", "string", pa.string(), lambda kept: kept.decode("utf-8", "ignore")),  # a character that a cut went through is left out
}


def _cut(keep: list[str], result: str):
    name, _, kind, made = RESULTS[result]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            texts, spots = _unpack(b), b.column("spots").to_pylist()
            n, removed, runs, out = [], [], [], []
            for t, s in zip(texts, spots, strict=True):
                cuts = merge_spans(s or [], len(t))
                edge = [0, *(x for cut in cuts for x in cut), len(t)]
                kept = b"".join([t[a:z] for a, z in zip(edge[::2], edge[1::2], strict=True)])
                n.append(len(t))
                removed.append(len(t) - len(kept))
                runs.append(len(cuts))
                out.append(made(kept))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(out, kind)], [*keep, "n_bytes", "n_removed", "n_spans", name])

    return run


def dedup(docs: DataFrame, keep: list[str], length: int = 100, k: int = K, result: str = "sha256") -> DataFrame:
    """The kept columns, n_bytes, n_removed, n_spans and kept_sha256 of every row; or, as `result` says, what is kept, as bytes or as text."""
    rows, shared_id = identified(docs, *dict.fromkeys([*keep, "text"]))
    per_doc = spans(rows, shared_id, length, k).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "stop")).alias("spots"))
    whole = packed(rows, shared_id).join(per_doc.withColumnsRenamed({"doc_id": "_doc_id", "tag": "_tag"}), ["_doc_id", "_tag"], "left")
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    name, sql, _, _ = RESULTS[result]
    return shared.in_arrow(whole.drop("_doc_id", "_tag"), _cut(keep, result), f"{kept}, n_bytes long, n_removed long, n_spans long, {name} {sql}")


#: DuckDB's SQL for the same over `documents` with unique ids: every string of 100 bytes, by a 64-bit hash.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, i, hash(array_slice(h, i + 1, i + 100)) AS k, doc_id * 4294967296 + i AS place FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT k, min(place) AS first FROM s GROUP BY k HAVING count(*) > 1),
l AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM s JOIN f USING (k) WHERE place > first),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT p.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS stop, string_agg(CASE WHEN a > before THEN hex(array_slice(h, before + 1, a)) ELSE '' END, '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN head IS NULL THEN h ELSE unhex(head || CASE WHEN n > stop THEN hex(array_slice(h, stop + 1, n)) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
