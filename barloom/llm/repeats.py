"""Removal of repeated passages by sorting suffixes, deep and shallow.

A string of LENGTH bytes always holds one chosen position: the leftmost least hash among its GRAM-byte windows. Equal
strings choose alike, so only the suffixes at chosen positions are sorted, and only those whose GRAM-byte window has
another chosen copy in the corpus. Such suffixes, cut where the strings that chose the position reach, are grouped by
the hash of their window. A group is sorted by the text that follows (and by the reversed text that
precedes): multikey quicksort down to a shallow depth, then a blind trie for each set that still agrees. From the two
orders and their common prefixes comes how far each suffix agrees with others on both sides; where both sides add up to
LENGTH, the bytes are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, in_cells, whole_groups

LENGTH = 400
GRAM = 64
#: Members of a group that one task takes whole; larger groups go to cells.
BLOCK = 4096
#: Bytes compared at once, and the depth where the quicksort hands over to blind tries.
STEP, SHALLOW = 16, 128

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_INDEX_BITS = 20
_INDEX = np.uint64((1 << _INDEX_BITS) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, at least n of each, modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE), np.full(size, _BACK)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _chosen(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a text of ``length`` to 2**20 bytes."""
    up, down = _power(len(text) + 1)
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(text) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span = length - gram + 1
    keyed = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // span)
    padded = np.full(rows * span, np.uint64(2**64 - 1))
    padded[: len(h)] = keyed
    padded = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(h) - span + 1], ahead[span - 1 : len(h)]) & _INDEX
    change = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    at = least[change].astype(np.int64)
    return np.column_stack([at, at - change, at - np.append(change[1:], len(least)) + 1]), h[at]


def chosen_positions(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position, most, least) and hashes: every string of ``length`` bytes has one chosen position, the same for
    equal strings; those of a row hold its position and begin between ``most`` and ``least`` bytes before it."""
    if len(text) < length:
        return np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    piece = (1 << _INDEX_BITS) - length
    found = [(lo, *_chosen(data[lo : lo + piece], length, gram)) for lo in range(0, len(text) - length + 1, piece - length + 1)]
    return np.concatenate([a + [lo, 0, 0] for lo, a, _ in found]), np.concatenate([h for _, _, h in found])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class _Node:
    """A branching of a blind trie: the position where what is below first differs, and a child for each byte there."""

    __slots__ = ("at", "below")

    def __init__(self, at: int, below: dict):
        self.at, self.below = at, below


def _blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Members in the order of their distinct strings. A string goes down blindly, by single bytes, to some leaf, is
    compared with that leaf alone, and then branches off where it first differs."""

    def byte(i: int, at: int) -> int:
        s = strings[i]
        return s[at] if at < len(s) else -1

    root: _Node | int = members[0]
    for i in members[1:]:
        path, node = [], root
        while isinstance(node, _Node):
            path.append(node)
            c = byte(i, node.at)
            node = node.below[c] if c in node.below else next(iter(node.below.values()))
        at = common_prefix(strings[i], strings[node])
        parent, node = None, root
        while isinstance(node, _Node) and node.at < at:
            parent, node = node, node.below[byte(i, node.at)]
        if isinstance(node, _Node) and node.at == at:
            node.below[byte(i, at)] = i
            continue
        other = node
        while isinstance(other, _Node):
            other = next(iter(other.below.values()))
        new = _Node(at, {byte(other, at): node, byte(i, at): i})
        if parent is None:
            root = new
        else:
            parent.below[byte(i, parent.at)] = new
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack.extend(node.below[c] for c in sorted(node.below, reverse=True))
        else:
            order.append(node)
    return order


def suffix_order(strings: list[bytes], step: int = STEP, shallow: int = SHALLOW) -> list[int]:
    """Indices of distinct strings in lexicographic order: multikey quicksort to ``shallow`` bytes, then blind tries."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            order += members
        elif depth >= shallow:
            order += _blind_trie(strings, members)
        else:
            pivot = strings[members[len(members) // 2]][depth : depth + step]
            less, same, more = [], [], []
            for i in members:
                piece = strings[i][depth : depth + step]
                (same if piece == pivot else less if piece < pivot else more).append(i)
            stack += [(more, depth), (same, depth + step), (less, depth)]
    return order


def _reach_by_pairs(ahead: list[bytes], behind: list[bytes], length: int, gram: int) -> list[tuple[int, int]]:
    """(bytes behind, bytes ahead) that each suffix shares with others of a small group of distinct ones."""
    n = len(ahead)
    best = [(0, 0)] * n
    if n == 2:
        pairs = [(0, 1, common_prefix(*ahead), common_prefix(*behind))]
    else:
        sides = []
        for strings in (ahead, behind):
            distinct = list(dict.fromkeys(strings))
            order = suffix_order(distinct)
            share = [common_prefix(distinct[x], distinct[y]) for x, y in zip(order, order[1:], strict=False)]
            rank = {distinct[x]: r for r, x in enumerate(order)}
            sides.append(([rank[s] for s in strings], share))
        (up, share_up), (down, share_down) = sides
        pairs = []
        for x in range(n):
            for y in range(x):
                p, q = (up[x], up[y]) if up[x] < up[y] else (up[y], up[x])
                f = min(share_up[p:q]) if p != q else len(ahead[x])
                p, q = (down[x], down[y]) if down[x] < down[y] else (down[y], down[x])
                pairs.append((x, y, f, min(share_down[p:q]) if p != q else len(behind[x])))
    for x, y, f, g in pairs:
        if f >= gram and f + g >= length:
            for z in (x, y):
                best[z] = (max(best[z][0], g), max(best[z][1], f))
    return best


def _classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each string, and for each rank the bytes shared with the rank before and the string's length."""
    distinct = list(dict.fromkeys(strings))
    order = suffix_order(distinct)
    rank = {distinct[x]: r for r, x in enumerate(order)}
    share = [0] + [common_prefix(distinct[x], distinct[y]) for x, y in zip(order, order[1:], strict=False)]
    return np.array([rank[s] for s in strings]), np.array(share), np.array([len(distinct[x]) for x in order])


def _reach_by_depth(ahead: list[bytes], behind: list[bytes], length: int, gram: int) -> list[tuple[int, int]]:
    """The same for a large group, without pairs: for each offset, suffixes in one class on both sides agree."""
    n = len(ahead)
    up, share_up, long_up = _classes(ahead)
    down, share_down, long_down = _classes(behind)
    most, least = np.full(n, -1), np.full(n, length + 1)
    for back in range(min(length - gram, int(long_down.max())) + 1):
        ok = np.flatnonzero((long_down[down] >= back) & (long_up[up] >= length - back))
        if len(ok) < 2:
            continue
        key = np.cumsum(share_up < length - back)[up[ok]] * (len(share_down) + 1) + np.cumsum(share_down < back)[down[ok]]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        met = ok[count[inverse] > 1]
        most[met] = back
        least[met] = np.minimum(least[met], back)
    return [(m, length - x) if m >= 0 else (0, 0) for m, x in zip(most.tolist(), least.tolist(), strict=True)]


def group_reach(ahead: list[bytes], behind: list[bytes], length: int = LENGTH, gram: int = GRAM, copies: list[int] | None = None) -> list[tuple[int, int]]:
    """(bytes behind, bytes ahead) of the repeated text around each suffix; (0, 0) where there is none.

    copies: for how many equal suffixes each one stands."""
    places: dict[tuple[bytes, bytes], list[int]] = {}
    for i, both in enumerate(zip(ahead, behind, strict=True)):
        places.setdefault(both, []).append(i)
    out = [(0, 0)] * len(ahead)
    distinct = list(places)
    if len(distinct) > 1:
        small = len(distinct) <= 24
        reach = (_reach_by_pairs if small else _reach_by_depth)([a for a, _ in distinct], [b for _, b in distinct], length, gram)
    else:
        reach = [(0, 0)]
    for (a, b), (back, on) in zip(distinct, reach, strict=True):
        own = places[a, b]
        if (len(own) > 1 or copies and max(copies[i] for i in own) > 1) and len(a) + len(b) >= length:
            back, on = len(b), len(a)
        for i in own:
            out[i] = (back, on)
    return out


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, hashes = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, h = chosen_positions(t.as_py(), length, gram)
                keys.append(np.full(len(a), k))
                rows.append(a)
                hashes.append(h)
            if keys:
                at, most, least = np.concatenate(rows).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(at), pa.array(most.astype(np.int16)), pa.array(least.astype(np.int16)), pa.array(np.concatenate(hashes).view(np.int64))],
                    names=["k", "at", "most", "least", "h"],
                )

    return run


def _contexts(length: int, segment: int):
    """The text around each place that its strings reach, in two parts; places of one text with equal surroundings share
    a row. segment: 0, or cut the strings' beginnings into
    segments and name each by the bytes that all its strings hold; strings are equal only if their names are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                own = batch.slice(part, 128)
                places: dict[tuple, list[int]] = {}
                for k, text, found in zip(own.column(0).to_pylist(), own.column(1), own.column(2).to_pylist(), strict=True):
                    text = text.as_py()
                    for x in found:
                        p, name = x["at"], x["h"]
                        if not segment:
                            places.setdefault((k, name, text[p : p + length - x["least"]], text[p - x["most"] : p]), []).append(p)
                            continue
                        for s in range(x["least"] // segment, x["most"] // segment + 1):
                            least, most = max(x["least"], s * segment), min(x["most"], s * segment + segment - 1)
                            core = text[max(0, p - s * segment) : p + length - s * segment - segment + 1]
                            key = hash_bytes(core, (name ^ s) & (2**64 - 1))
                            places.setdefault((k, key, text[p : p + length - least], text[p - most : p]), []).append(p)
                rows = [(k, h, at, ahead, behind) for (k, h, ahead, behind), at in places.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True)], names=["k", "h", "at", "ahead", "behind"])

    return run


def hash_bytes(data: bytes, seed: int) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (h >> 63 << 64)


def _repeated(length: int, gram: int):
    """Rows (id, back, on) of the suffixes around which text is repeated; ``id`` columns are what comes before ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["h", "cell"], rows=20_000):
            ahead = t["ahead"].to_pylist()
            behind = [x[::-1] for x in t["behind"].to_pylist()]
            copies = t["copies"].to_pylist()
            back, on = np.zeros(len(ahead), dtype=np.int64), np.zeros(len(ahead), dtype=np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ahead)], strict=True):
                if e - s > 1 or copies[s] > 1:
                    for i, (b, f) in enumerate(group_reach(ahead[s:e], behind[s:e], length, gram, copies[s:e]), start=s):
                        back[i], on[i] = b, f
            hit = pa.array(np.flatnonzero(on))
            keep = [c for c in t.column_names if c not in ("cell", "ahead", "behind", "copies")]
            yield pa.RecordBatch.from_arrays([t[c].take(hit).combine_chunks() for c in keep] + [pa.array(back).take(hit), pa.array(on).take(hit)], names=[*keep, "back", "on"])

    return run


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            own = batch.slice(part, 512)
            rows = []
            for text, spans in zip(own.column(1), own.column(2).to_pylist(), strict=True):
                text, runs = text.as_py(), _merged(spans or [])
                kept, last = [], 0
                for lo, hi in runs:
                    kept.append(text[last:lo])
                    last = hi
                kept.append(text[last:])
                rows.append((len(text), sum(hi - lo for lo, hi in runs), len(runs), b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    own.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows]),
                    pa.array([r[3] for r in rows], pa.binary()),
                    pa.array([r[3].decode(errors="replace") for r in rows], pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"],
            )


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(k, spans array<struct<lo,hi>>) of the texts (k long, text binary) that hold a repeated string of ``length`` bytes.

    The union of a text's spans is every byte covered by such a string that also starts elsewhere in the table, in the
    same text or another. A window that occurs more than ``block`` times makes a crowd. Its contexts are divided by most
    of the bytes that equal strings must share and equal ones are collapsed to one with a count, before any task takes a
    group; what is still larger than a block is dealt into cells of bounded size which every two members share.
    """
    anchors = texts.where(F.length("text") >= length).select("k", "text").mapInArrow(_anchors(length, gram), "k long, at long, most short, least short, h long")
    repeated = checkpointed(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    places = anchors.join(repeated, "h").groupBy("k").agg(F.collect_list(F.struct("at", "most", "least", "h", "n")).alias("found"))
    # all columns, as in the join that cuts: Spark then shuffles the texts once for both
    others = [c for c in texts.columns if c not in ("k", "text")]
    placed = texts.join(places, "k")
    fields = "k long, h long, at array<long>, ahead binary, behind binary"

    def contexts(which, segment: int) -> DataFrame:
        own = placed.select("k", "text", F.filter("found", which).alias("found"), *others).where(F.size("found") > 0)
        return own.mapInArrow(_contexts(length, segment), fields)

    sorted_by = lambda df: df.repartition("h", "cell").sortWithinPartitions("h", "cell")
    spans = (
        sorted_by(contexts(lambda x: x["n"] <= block, 0).select("h", F.lit(0).cast("long").alias("cell"), "k", "at", "ahead", "behind", F.size("at").cast("long").alias("copies")))
        .mapInArrow(_repeated(length, gram), "h long, k long, at array<long>, back long, on long")
        .select("k", "at", "back", "on")
    )
    if not repeated.where(F.col("n") > block).isEmpty():
        crowd = contexts(lambda x: x["n"] > block, max(1, (length - gram) // 8))
        named = F.md5(F.concat(F.length("behind").cast("string").cast("binary"), F.lit(b"|"), "behind", "ahead")).alias("name")
        distinct = crowd.groupBy("h", "ahead", "behind").agg(F.sum(F.size("at").cast("long")).alias("copies"))
        sizes = distinct.groupBy("h").agg(F.count("*").alias("n"), F.sum("copies").alias("all")).where("all > 1").drop("all")
        dealt = in_cells(distinct.join(sizes, "h").withColumn("name", named), "n", "name", block)
        reach = (
            sorted_by(dealt.select("h", "cell", "name", "ahead", "behind", "copies"))
            .mapInArrow(_repeated(length, gram), "h long, name string, back long, on long")
            .groupBy("h", "name")
            .agg(F.max("back").alias("back"), F.max("on").alias("on"))
        )
        spans = spans.unionByName(crowd.select("k", "at", "h", named).join(reach, ["h", "name"]).select("k", "at", "back", "on"))
    own = F.transform("at", lambda p: F.struct((p - F.col("back")).alias("lo"), (p + F.col("on")).alias("hi")))
    return spans.groupBy("k").agg(F.flatten(F.collect_list(own)).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, text) of every row; see the module's text.

    Texts are UTF-8 bytes, a null text is empty, and a text shorter than ``length`` keeps every byte. Rows that repeat a
    doc_id are texts of their own. Rows are numbered by their place in the input, which must come out the same when a
    lost part is read again, as a scan or a checkpoint does. Cuts fall on bytes and may split a character: ``text``, what
    is kept as a string, has U+FFFD for its rest.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )
    spans = repeated_spans(texts, length, gram, block)
    return (
        texts.join(spans, "k", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string")
    )


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")
