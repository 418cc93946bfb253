"""Suffix-array dedup of byte substrings.

Factors of texts that may repeat are routed to shards by their anchor (see
repeats.py). Each shard builds a suffix array over its factors by
Larsson-Sadakane refinement (ranks double their depth, sorted groups stay),
takes common prefixes with Kasai's invariant (all factors advance in lockstep)
and groups the windows whose prefixes agree. The smallest document of a group
keeps its copy.

Factors of one anchor that are too many for one shard are spread over several
of them; such shards are merged by binary search of their sorted windows.

Edge cases: null text has no bytes; texts shorter than a window lose none;
matches never cross documents and never count inside one; rows with a null id
are left as they are; rows that repeat an id must repeat its text and don't
count against each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import small_batches, table
from basewright.llm.repeats import Powers, covered, mix, repeated_windows

LENGTH, GRAM = 50, 20
#: Symbols that the first ranks look at: 7 of 9 bits each.
_FIRST = 7


def byte_symbols():
    """A function from a text to the digests of its bytes."""
    digests = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return lambda text: digests[np.frombuffer(text, np.uint8)]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of small symbols, sorted to ``depth`` at least.

    0 ends a string, also the last one; an end sorts before all else, and ends by their place.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    string = np.searchsorted(ends, np.arange(n))
    left = ends[string] - np.arange(n)
    pad = np.zeros(n + _FIRST, np.int64)
    pad[:n] = text
    key = np.zeros(n, np.int64)
    for j in range(_FIRST):
        key = (key << 9) | np.where(left >= j, pad[j : n + j], 0)
    sa = np.argsort(key)
    # suffixes that end at once: their equal keys, which no others have, go by the string's place
    at = np.flatnonzero(left[sa] < _FIRST)
    few = sa[at]
    sa[at] = few[np.lexsort((string[few], key[few]))]
    new = np.ones(n, bool)
    sorted_key = key[sa]
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (left[sa[1:]] < _FIRST)
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n)))
    have = _FIRST
    while have < depth:
        # members of unsorted groups, in the order of the array
        size = np.diff(np.append(start, n))
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            break
        i = sa[at]
        after = np.full(len(i), -1, np.int64)
        inside = i + have < n
        after[inside] = rank[i[inside] + have]
        order = np.argsort(rank[i] * (n + 1) + after + 1)
        i, after, group = i[order], after[order], rank[i][order]
        sa[at] = i
        split = np.ones(len(i), bool)
        split[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        heads = np.flatnonzero(split)
        rank[i] = np.repeat(at[heads], np.diff(np.append(heads, len(i))))
        new[at] = split
        start = np.flatnonzero(new)
        have *= 2
    # a rank of its own for each suffix
    rank[sa] = np.arange(n)
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By position: the prefix shared with the suffix before it in the array, up to the end of the string.

    Kasai: the next position shares at least one symbol less. All strings step together.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max()) if len(sizes) else 0):
        lane = np.flatnonzero(sizes > step)
        i = starts[lane] + step
        r = rank[i]
        j = np.where(r > 0, sa[np.maximum(r - 1, 0)], n)
        k = np.maximum(h[lane] - 1, 0)
        k[j == n] = 0
        go = np.flatnonzero(j < n)
        while len(go):  # only lanes that still grow
            a, b = i[go] + k[go], j[go] + k[go]
            symbol = text[a]
            go = go[(symbol > 0) & (symbol == text[np.minimum(b, n - 1)])]
            k[go] += 1
        out[i] = k
        h[lane] = k
    return out


def _smaller_copies(length: int):
    def compare(docs, anchors, counts, content) -> np.ndarray:
        """Flags of windows that a factor of a smaller document has too."""
        sizes = counts + length - 1
        starts = np.cumsum(sizes + 1) - sizes - 1
        n = int((sizes + 1).sum())
        text = np.zeros(n, np.int64)
        lane = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        text[lane] = np.frombuffer(content, np.uint8).astype(np.int64) + 1
        sa, rank = suffix_array(text, int(sizes.max()) + 1)
        lcp = common_prefixes(text, sa, rank, starts, sizes)
        group = np.flatnonzero(lcp[sa] < length)  # where a new group starts in the array
        owner = np.full(n, np.iinfo(np.int64).max)
        owner[lane] = np.repeat(docs, sizes)
        valid = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        judged = np.full(n, np.iinfo(np.int64).max)
        judged[valid] = owner[valid]
        group = group if len(group) and group[0] == 0 else np.concatenate([[0], group])
        least = np.repeat(np.minimum.reduceat(judged[sa], group), np.diff(np.append(group, n)))
        return least[rank[valid]] < owner[valid]

    return compare


def _window_digests(length: int):
    def digests(counts, content) -> np.ndarray:
        """The digest of every window, factor after factor."""
        up, down = Powers().upto(len(content) + 1)
        sums = np.zeros(len(content) + 1, np.uint64)
        np.cumsum(byte_symbols()(content) * up[: len(content)], out=sums[1:])
        sizes = counts + length - 1
        at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return mix((sums[at + length] - sums[at]) * down[at])

    return digests


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, edges (start, stop, start, …), kept (remaining bytes), kept_sha256."""
    gram = min(GRAM, length)
    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    content = lambda raw, r, run: raw[r.first[run] : r.first[run] + r.count[run] - 1 + length]
    found = repeated_windows(rows, byte_symbols, gram, length, True, content, _smaller_copies(length), _window_digests(length), length + (length - gram + 1) // 2)

    def cut(batches):
        sym, powers = byte_symbols(), Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for raw, runs, starts in zip(part["text"].cast(pa.binary()), part["runs"].to_pylist(), part["starts"].to_pylist()):
                    data = raw.as_py() or b""
                    edges, kept = [], data
                    if runs or starts:
                        gone = covered(sym(data), gram, length, powers, runs, starts)
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    out.append((len(data), len(data) - len(kept), len(edges) // 2, edges, kept, hashlib.sha256(kept).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part["doc"], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc", "n_bytes", "n_removed", "n_spans", "edges", "kept", "kept_sha256"])

    return small_batches(found).mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, edges array<long>, kept binary, kept_sha256 string").withColumnRenamed("doc", key)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
