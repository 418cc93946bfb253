"""Finding repeated windows: what substring and suffix-array dedup share.

A text is a row of symbols (word or byte digests). A window is ``length``
symbols. Its anchor is the k-gram inside it with the least digest, so equal
windows have equal anchors at equal places. Consecutive windows with one
anchor form a run; the text of a run, a factor, is what the index refers to.

1. ``index_runs`` reads the texts in blocks, settles what repeats inside a
   block and sends each other run to the range of its anchor, as packed arrays:
   16 bytes a run, a hot factor once a block.
2. ``settle`` merges a range: factors found elsewhere are settled as a whole;
   where an anchor has several factors, one text of each is asked for.
3. the caller compares the asked factors window by window (``ask_content``
   routes them to shards) and gets flags for single windows.

Factors are equal if 96 bits and the range are: 32 of the anchor, 40 of the
factor, and 12 each of what stands left and right of the anchor. A window holds
the anchor and at least half of the rest on one side, so factors without an
equal neighbourhood on either side have no window in common and aren't asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import small_batches, stored

_C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 22
#: Rows of one block, and symbols after which a block ends.
BLOCK_ROWS, BLOCK_SYMBOLS = 4_000, 3_000_000
#: Index entries that one range holds on average, and their layout.
RANGE_ENTRIES = 1_000_000
#: Asked factors of one anchor beyond which they are spread over several shards.
CROWD = 2_000
#: Texts whose factors are routed together, and shards' worth of content in one of a crowd, whose windows are only sorted.
ASK_ROWS, CROWD_SHARDS = 4_000, 4
ENTRY = np.dtype([("anchor", "<u4"), ("digest", "<u8"), ("doc", "<u2"), ("run", "<u2")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[0]
    x = (x ^ (x >> np.uint64(27))) * _C[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and its inverse modulo 2^64, as many as needed so far."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 65_536)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(self.n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


@dataclass
class Runs:
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def windows(self, run: int, length: int) -> np.ndarray:
        """The digests of a run's windows."""
        at = self.first[run] + np.arange(self.count[run])
        return mix((self.sums[at + length] - self.sums[at]) * self.down[at])


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def runs_of(symbols: np.ndarray, k: int, length: int, powers: Powers, places_only: bool = False, digests: bool = True) -> Runs | None:
    """The runs of a text, None if it is shorter than a window; ``places_only`` leaves out anchors and digests, ``digests`` the latter."""
    n = len(symbols)
    if n < length:
        return None
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    width, windows = length - k + 1, n - length + 1
    mask = np.uint64(2 * _CHUNK - 1)
    at = np.empty(windows, np.int64)
    for c in range(0, windows, _CHUNK):
        part = grams[c : min(c + _CHUNK, windows) + width - 1]
        key = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        at[c : c + _CHUNK] = (_least(key, width) & mask).astype(np.int64) + c
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    count = np.diff(np.append(first, windows))
    if places_only:
        return Runs(first, count, first, first, sums, down)
    anchor = mix(grams[at[first]] + np.uint64(1))  # minima crowd at the low end; mixed again they fill all ranges
    if not digests:
        return Runs(first, count, anchor, first, sums, down)
    half = (length - k + 1) // 2
    spot, stop = at[first], first + count - 1 + length

    def beside(start: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """12 bits of the ``half`` symbols from ``start`` on; 0 outside the factor."""
        start = np.where(inside, start, 0)
        h = mix((sums[start + half] - sums[start]) * down[start])
        return np.where(inside, h % np.uint64(4095) + np.uint64(1), np.uint64(0))

    left, right = beside(spot - half, spot - half >= first), beside(spot + k, spot + k + half <= stop)
    place = (count.astype(np.uint64) << np.uint64(32)) | (at[first] - first).astype(np.uint64)
    whole = (sums[first + count - 1 + length] - sums[first]) * down[first]
    digest = mix(whole ^ mix(place + np.uint64(1))) & ~np.uint64(0xFFFFFF) | left << np.uint64(12) | right
    return Runs(first, count, anchor, digest, sums, down)


def _blocks(batches: Iterator[pa.RecordBatch], symbols: Callable) -> Iterator[list]:
    """Lists of (doc, symbols) of bounded size."""
    block, held = [], 0
    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].cast(pa.binary())):
            if doc is None or not text.is_valid:
                continue
            s = symbols(text.as_py())
            block.append((doc, s))
            held += len(s)
            if held > BLOCK_SYMBOLS or len(block) >= BLOCK_ROWS:
                yield block
                block, held = [], 0
    if block:
        yield block


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first counts most) and, in that order, where a new group starts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


INDEX = "part int, settled boolean, docs binary, bases binary, entries binary"


def index_runs(df: DataFrame, symbols: Callable[[], Callable], k: int, length: int, ranges: int, smaller: bool) -> DataFrame:
    """Rows of INDEX: packed runs for the ranges 0 to ``ranges - 1``; settled ones go to any range.

    ``smaller``: a window counts as repeated only if a document with a smaller id has it;
    else any other place counts.
    """

    def run(batches):
        sym, powers = symbols(), Powers()
        for block in _blocks(batches, sym):
            docs, bases, doc_of, run_of, anchors, digests = [], [], [], [], [], []
            for doc, s in block:
                r = runs_of(s, k, length, powers)
                if r is None:
                    continue
                for base in range(0, len(r.first), 65_536):
                    n = min(65_536, len(r.first) - base)
                    doc_of.append(np.full(n, len(docs), np.int64))
                    run_of.append(np.arange(n))
                    anchors.append(r.anchor[base : base + n])
                    digests.append(r.digest[base : base + n])
                    docs.append(doc)
                    bases.append(base)
            if not docs:
                continue
            ids, base = np.array(docs, np.int64), np.array(bases, np.int64)
            doc_of, run_of, anchors, digests = map(np.concatenate, (doc_of, run_of, anchors, digests))
            owner = ids[doc_of]
            order, new = _groups(anchors, digests, owner) if smaller else _groups(anchors, digests)
            a, d = anchors[order], digests[order]
            head = np.ones(len(order), bool)
            head[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            start = np.flatnonzero(head)
            size = np.diff(np.append(start, len(order)))
            if smaller:
                send = owner[order] == np.repeat(owner[order][start], size)
                settled, twice = ~send, np.zeros(len(order), bool)
            else:
                settled = np.repeat(size > 1, size)
                send = head
                twice = head & settled
            yield _packed(int(anchors[0] % np.uint64(ranges)), True, ids, base, order[settled], doc_of, run_of, anchors, digests)
            picked = np.concatenate([order[send], order[twice]])
            part = (anchors[picked] >> np.uint64(32)).astype(np.int64) * ranges >> 32
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(ranges + 1))
            for p in range(ranges):
                if edges[p] < edges[p + 1]:
                    yield _packed(p, False, ids, base, picked[by[edges[p] : edges[p + 1]]], doc_of, run_of, anchors, digests)

    return small_batches(df).mapInArrow(run, INDEX)


def _packed(part, settled, ids, base, at, doc_of, run_of, anchors, digests) -> pa.RecordBatch:
    used, local = np.unique(doc_of[at], return_inverse=True)
    e = np.empty(len(at), ENTRY)
    e["anchor"], e["digest"], e["doc"], e["run"] = anchors[at] & np.uint64(0xFFFFFFFF), digests[at], local, run_of[at]
    row = [pa.array([part], pa.int32()), pa.array([settled]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[used], base[used], e))]
    return pa.RecordBatch.from_arrays(row, ["part", "settled", "docs", "bases", "entries"])


def _unpacked(docs: list[bytes], bases: list[bytes], entries: list[bytes]):
    doc, run, anchor, digest = [], [], [], []
    for a, b, c in zip(docs, bases, entries):
        e = np.frombuffer(c, ENTRY)
        doc.append(np.frombuffer(a, np.int64)[e["doc"]])
        run.append(np.frombuffer(b, np.int64)[e["doc"]] + e["run"])
        anchor.append(e["anchor"])
        digest.append(e["digest"])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (doc, run, anchor, digest))


FOUND = "doc long, kind int, runs binary, n int"


def _found(doc: np.ndarray, run: np.ndarray, kind: int) -> pa.Table:
    """Per document the spans (first, past the last) of its distinct numbers, and how many numbers."""
    order = np.lexsort((run, doc))
    d, r = doc[order], run[order].astype(np.int64)
    once = np.ones(len(d), bool)
    once[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
    d, r = d[once], r[once]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1] + 1)
    start = np.flatnonzero(new)
    spans = np.stack([r[start], r[np.append(start[1:], len(r))[: len(start)] - 1] + 1], axis=1).astype(np.int32)
    ids, at = np.unique(d[start], return_index=True)
    _, n = np.unique(d, return_counts=True)
    offsets = (np.append(at, len(start)) * 8).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spans.tobytes())])
    return pa.table({"doc": pa.array(ids, pa.int64()), "kind": pa.array(np.full(len(ids), kind, np.int32)), "runs": blobs, "n": pa.array(n.astype(np.int32))})


def settle(index: DataFrame, smaller: bool) -> DataFrame:
    """Rows of FOUND per document: kind 0 has spans of settled runs, kind 1 of asked runs.

    Kind 3 are asked runs of crowded anchors, whose factors don't fit one shard.
    """

    def merge(table: pa.Table) -> pa.Table:
        known, open_ = (table.filter(x) for x in (table["settled"], pc.invert(table["settled"])))
        rows = lambda t: _unpacked(*(t[c].to_pylist() for c in ("docs", "bases", "entries")))
        done_doc, done_run, _, _ = rows(known)
        doc, run, anchor, digest = rows(open_)
        order, _ = _groups(anchor, digest, doc)
        a, g, d = anchor[order], digest[order], doc[order]
        head = np.ones(len(order), bool)
        head[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(order)))
        if smaller:
            settled = d > np.repeat(d[start], size)
            ask = ~settled
        else:
            settled = np.repeat(size > 1, size)
            ask = head.copy()
        low = np.uint64(0xFFF)
        near = _shared(a[start], g[start] >> np.uint64(12) & low) | _shared(a[start], g[start] & low)
        ask &= np.repeat(near, size)
        top = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        total = np.diff(np.append(top, len(a)))
        crowded = np.repeat(np.add.reduceat(ask.astype(np.int64), top) > CROWD, total) if len(a) else ask
        r = run[order]
        return pa.concat_tables([_found(np.concatenate([done_doc, d[settled]]), np.concatenate([done_run, r[settled]]), 0), _found(d[ask & ~crowded], r[ask & ~crowded], 1), _found(d[ask & crowded], r[ask & crowded], 3)])

    return index.groupBy("part").applyInArrow(merge, FOUND)


def _shared(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which factors have a neighbourhood (not 0) that another factor of the anchor has too."""
    order, new = _groups(anchor, side)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return out & (side > 0)


def per_document(found: DataFrame, label: str, **kinds: int) -> DataFrame:
    """doc and, by name, the list of its blobs of a kind, stored."""
    blobs = [F.collect_list(F.when(F.col("kind") == k, F.col("runs"))).alias(name) for name, k in kinds.items()]
    return stored(found.groupBy("doc").agg(*blobs), label)


def joined_spans(blobs: list[bytes] | None) -> np.ndarray:
    """The numbers that the spans of all blobs cover."""
    if not blobs:
        return np.empty(0, np.int64)
    rows = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 2) for b in blobs])
    return np.unique(np.concatenate([np.arange(a, b) for a, b in rows])) if len(rows) else np.empty(0, np.int64)


CONTENT = "shard int, docs binary, anchors binary, firsts binary, counts binary, content binary"


def ask_content(df: DataFrame, symbols: Callable[[], Callable], k: int, length: int, shards: int, crowds: int, content: Callable) -> DataFrame:
    """The asked factors of (doc, text, runs, crowd), routed to the shard of their anchor.

    Those of ``crowd`` go to any of ``crowds`` shards, numbered from -1 down. ``content(text, runs, run)`` gives a factor's bytes.
    """

    def sliced(values: np.ndarray | bytes, edges: np.ndarray) -> pa.Array:
        """Blobs of the bytes between edges."""
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(values)])

    def run(batches):
        sym, powers = symbols(), Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, ASK_ROWS):
                part, docs, places, found = batch.slice(at, ASK_ROWS), [], [], []
                for doc, text, runs, crowd in zip(part["doc"].to_pylist(), part["text"].cast(pa.binary()), part["runs"].to_pylist(), part["crowd"].to_pylist()):
                    text = text.as_py()
                    asked, spread = joined_spans(runs), joined_spans(crowd)
                    r = runs_of(sym(text), k, length, powers, digests=len(spread) > 0)
                    shard = (r.anchor[asked] >> np.uint64(32)).astype(np.int64) * shards >> 32
                    if len(spread):
                        shard = np.append(shard, -1 - ((r.digest[spread] >> np.uint64(24)) % np.uint64(crowds)).astype(np.int64))
                        asked = np.append(asked, spread)
                    docs.append(np.full(len(asked), doc, np.int64))
                    places.append((shard, r.anchor[asked], r.first[asked], r.count[asked]))
                    found += [content(text, r, i) for i in asked.tolist()]
                if not found:
                    continue
                shard, anchor, first, count = (np.concatenate(x) for x in zip(*places))
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                edges = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
                ends = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))[order]))
                cols = [sliced(x[order].astype(t).tobytes(), edges * np.dtype(t).itemsize) for x, t in ((np.concatenate(docs), "<i8"), (anchor, "<u8"), (first, "<i4"), (count, "<i4"))]
                cols.append(sliced(b"".join([found[i] for i in order.tolist()]), ends[edges]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int32()), *cols], ["shard", "docs", "anchors", "firsts", "counts", "content"])

    return small_batches(df).mapInArrow(run, CONTENT)


def _shard_arrays(table: pa.Table):
    get = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    docs, firsts, counts = get("docs", "<i8"), get("firsts", "<i4").astype(np.int64), get("counts", "<i4").astype(np.int64)
    starts = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return docs, get("anchors", "<u8"), counts, b"".join(table["content"].to_pylist()), np.repeat(docs, counts), starts


def compared(content: DataFrame, compare: Callable, digests: Callable, smaller: bool, crowds: int) -> DataFrame:
    """Rows of FOUND, kind 2: spans of repeated window starts, by ``compare(docs, anchors, counts, content)``.

    ``compare`` gives a flag for every window, factor after factor. Shards of
    crowded anchors are merged: each sends its own distinct windows, sorted, to
    the range of their digests, where binary search finds those of other shards.
    """

    def shard(table: pa.Table) -> pa.Table:
        docs, anchors, counts, data, owner, starts = _shard_arrays(table)
        flags = compare(docs, anchors, counts, data)
        return _found(owner[flags], starts[flags], 2)

    sent = "part int, shard int, digests binary, docs binary, starts binary, many binary"

    def crowd(table: pa.Table) -> pa.Table:
        docs, anchors, counts, data, owner, starts = _shard_arrays(table)
        seen = digests(counts, data)
        order = np.lexsort((owner, seen))
        d = seen[order]
        head = np.concatenate([[True], d[1:] != d[:-1]])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(d)))
        # a window goes on once for each document that may be the smallest here, or else once with its number
        keep = owner[order] == np.repeat(owner[order][at], size) if smaller else np.ones(len(d), bool)
        o, many = order[keep], np.repeat(size, size)[keep]
        part = (seen[o] >> np.uint64(32)).astype(np.int64) * crowds >> 32
        edges = np.searchsorted(part, np.arange(crowds + 1))
        lost = order[~keep]
        parts = [p for p in range(crowds) if edges[p] < edges[p + 1]]
        cut = lambda x, t: [x[edges[p] : edges[p + 1]].astype(t).tobytes() for p in parts]
        number = [table["shard"][0].as_py()] * len(parts)
        rows = {"part": pa.array(parts, pa.int32()), "shard": pa.array(number, pa.int32()), "digests": cut(seen[o], "<u8"), "docs": cut(owner[o], "<i8"), "starts": cut(starts[o], "<i4"), "many": cut(many, "<i4")}
        gone = {"part": pa.array([-1], pa.int32()), "shard": pa.array([0], pa.int32()), "digests": [b""], "docs": [owner[lost].astype("<i8").tobytes()], "starts": [starts[lost].astype("<i4").tobytes()], "many": [b""]}
        kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("digests", "docs", "starts", "many"))])
        return pa.concat_tables([pa.table(rows, schema=kinds), pa.table(gone, schema=kinds)])

    def both(one, other):
        """Two sorted lists of distinct windows as one; the smaller document of a window stays, or its numbers are added."""
        (known, value), (d, new) = one, other
        place = np.searchsorted(known, d)
        old = np.zeros(len(d), bool)
        inside = place < len(known)
        old[inside] = known[place[inside]] == d[inside]
        value = value.copy()
        value[place[old]] = np.minimum(value[place[old]], new[old]) if smaller else value[place[old]] + new[old]
        return np.insert(known, place[~old], d[~old]), np.insert(value, place[~old], new[~old])

    def merge(table: pa.Table) -> pa.Table:
        lists = [[np.frombuffer(x, t) for x, t in zip(row, ("<u8", "<i8", "<i4", "<i4"))] for row in zip(*(table[c].to_pylist() for c in ("digests", "docs", "starts", "many")))]
        if table["part"][0].as_py() < 0:
            return _found(np.concatenate([x[1] for x in lists]), np.concatenate([x[2] for x in lists]), 2)
        level = []
        for d, doc, _, many in lists:  # each sorted
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            level.append((d[at], (doc if smaller else many.astype(np.int64))[at]))
        while len(level) > 1:  # by twos, so that a window is moved only as often as their number can be halved
            level = [both(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        known, value = level[0]
        d, doc, start = (np.concatenate([x[i] for x in lists]) for i in range(3))
        best = value[np.searchsorted(known, d)]
        flags = best < doc if smaller else best > 1
        return _found(doc[flags], start[flags], 2)

    spread = content.where("shard < 0").groupBy("shard").applyInArrow(crowd, sent)
    return content.where("shard >= 0").groupBy("shard").applyInArrow(shard, FOUND).union(spread.groupBy("part").applyInArrow(merge, FOUND))


def repeated_windows(df: DataFrame, symbols: Callable, k: int, length: int, smaller: bool, content: Callable, compare: Callable, digests: Callable, factor_bytes: int, shard_bytes: int = 3 << 19) -> DataFrame:
    """Join (doc, text) with ``runs`` (spans of settled runs) and ``starts`` (spans of window starts)."""
    symbols_seen = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, int(symbols_seen * 2 / (length - k + 2)) // RANGE_ENTRIES)
    found = stored(settle(index_runs(df, symbols, k, length, ranges, smaller), smaller), "found")
    asked = per_document(found.where("kind <> 0"), "asked", runs=1, crowd=3)
    volume = {r["kind"]: r["n"] * factor_bytes for r in found.where("kind <> 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    shards, crowds = max(16, volume.get(1, 0) // shard_bytes), max(16, volume.get(3, 0) // (CROWD_SHARDS * shard_bytes))
    routed = stored(ask_content(df.join(asked, "doc"), symbols, k, length, shards, crowds, content), "factors")
    single = compared(routed, compare, digests, smaller, crowds)
    total = per_document(found.where("kind = 0").union(single), "repeats", runs=0, starts=2)
    return df.join(total, "doc", "left")


def covered(symbols: np.ndarray, k: int, length: int, powers: Powers, runs: list[bytes] | None, starts: list[bytes] | None) -> np.ndarray:
    """Which symbols lie in a repeated window."""
    n = len(symbols)
    edge = np.zeros(n + 1, np.int64)
    if runs and n >= length:
        r = runs_of(symbols, k, length, powers, places_only=True)
        at = joined_spans(runs)
        np.add.at(edge, r.first[at], 1)
        np.add.at(edge, r.first[at] + r.count[at] - 1 + length, -1)
    for blob in starts or ():
        for a, b in np.frombuffer(blob, np.int32).reshape(-1, 2):
            edge[a] += 1
            edge[b - 1 + length] -= 1
    return np.cumsum(edge[:-1]) > 0
