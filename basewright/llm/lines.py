"""Fuzzy line dedup by SimHash, pigeonhole blocks of words and edit similarity.

A line is normalised (A-Z lower-cased, ASCII white space collapsed) and, from
``MIN_WORDS`` words on, gets a SimHash of 256 bits of its words, the repeats of
a word numbered. Lines of edit similarity 0.8 differ in 52 of these bits, so no
blocks of bits find them. Blocks are made of words instead: of n words of one
line at most n // 5 are not in the other, so if both are put in one order, the
second word that they share is among the first n // 5 + 2 of each. The order is
by classes of frequency and then by digest. A line goes to a bucket for each
pair of its first n // 5 + 2 words, but at most ``FIRST_WORDS``: similar lines
of up to 34 words always meet; of longer ones, of which the first words by
digest are a fair sample, those of similarity 0.8 miss each other three times
in a thousand, those of 0.9 less than once.
A bucket of over ``ALL_PAIRS`` lines is split by the next word that two lines
share, which is among the first n // 5 + 3 of each, and once more by the fourth;
lines of 5 words share no more. Buckets whose lines are mostly alike, and those
still large at the end, link their lines to hubs instead.
Members of a bucket whose lengths allow it and that are at most ``BITS_APART``
of the first 64 bits, ``HALF_APART`` of 128 and ``WIDE_APART`` of all bits apart are confirmed by
their edit similarity over words; connected lines form a group, and the
occurrence that comes first by (id, line number) stays. The frequencies are
counted over all lines; they decide the order, and so bucket sizes. In smaller
buckets members that hang together within ``ALIKE_BITS`` of the first 64 bits
link to hubs if they are over ``CROWDED``: copies give no row for each pair.

Shorter lines have no fuzzy matches. With ``short`` exact repeats of them
(by the normalised words) go too; blank lines always stay.

Edge cases: null text has no lines and stays null; rows with a null id are left as they are; rows that repeat an id must
repeat its text and keep the same lines; an empty table gives an empty result;
extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import ID_ROWS, give_back, small, small_batches, stored, table
from basewright.llm.groups import components, link_buckets, rooted

MIN_WORDS = 5
#: At similarity 0.8 a pair differs in 13 of 64 bits, and in more than 29 about once in a million;
#: so it does in more than 84 of 256, where it differs in 52.
BITS_APART, WIDE_APART = 29, 84
#: The same of the first 128 bits, where it differs in 26. Unrelated lines are within it three times in a thousand, but
#: within BITS_APART of 64 bits one time in four: of the latter a bucket would give a row for every fourth pair.
HALF_APART = 49
#: Edit similarity, and the same as a fraction.
SIMILARITY, PER = 0.8, (4, 5)
#: Counters of words, as a power of two.
SLOT_BITS, COUNT_SLICES = 20, 64
#: Bits for each place that a text is searched for, at least, and bits of a slice of them.
PLACE_BITS, SLICE_BITS = 16, 16
#: Shares of the lines from which on a word comes later in the order, and the first words whose pairs are a line's keys.
OFTEN, FIRST_WORDS = np.array([0.0005, 0.002, 0.01, 0.05]), 8
#: Words of a key at most; keys of d words are made of the first FIRST_WORDS + 2 * (d - 2), which keeps the recall of pairs.
MOST_WORDS = 4
#: Members up to which a bucket compares its pairs in place; larger ones are split or link to hubs.
ALL_PAIRS = 200
#: Members that a large bucket is compared with, and the share of lines at most so many of 64 bits from one of them from which on
#: it is linked, not split. Both ways find the same pairs; unrelated lines of frequent words are often within BITS_APART.
HUBS, ALIKE, ALIKE_BITS = 8, 0.5, 16
#: Members of a smaller bucket that are alike and from which on they link to hubs too.
CROWDED = 8
SIMS = ["sim", "sim2", "sim3", "sim4"]
_LOOK = ["key", "n", "sim", "sim2"]
#: Texts whose words are cut and hashed at once: they should fit the processor's cache.
FEW_TEXTS = 100
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bucket entries that one range holds on average, and bytes of removals that may be broadcast.
RANGE_ENTRIES = 1_000_000
REMOVED_BYTES = 64 << 20


def line_words(line: bytes) -> list[bytes]:
    return line.lower().split()


def line_key(words: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def word_digests(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all words, line after line, and the number of words of each line.

    All words are hashed at once, eight bytes in a step; words of up to eight bytes have no digest in common.
    """
    sizes = np.array([len(w) for w in lines], np.int64)
    data = b" ".join(chain.from_iterable(lines))
    if not data:
        return np.empty(0, np.uint64), sizes
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    start = np.append(0, gaps + 1)
    left = np.append(gaps, len(data)) - start
    eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))  # from each byte on
    out = _mixed((eights[start] & _BYTES[np.minimum(left, 8)]) * _MIX[0])
    more = np.flatnonzero(left > 8)
    length = left.astype(np.uint64)
    while len(more):
        start[more] += 8
        left[more] -= 8
        out[more] = _mixed((out[more] ^ (eights[start[more]] & _BYTES[np.minimum(left[more], 8)])) * _MIX[0])
        more = more[left[more] > 8]
    return _mixed(_mixed((out + length) * _MIX[0]) * _MIX[0]), sizes


def line_features(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The digests in order within each line, repeats of a word numbered, so that all differ."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(owner.astype(np.uint64) << np.uint64(40) | flat >> np.uint64(24))
    flat, at = flat[order], np.arange(len(flat))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    again = nth > 0
    flat[again] = _mixed((flat[again] + nth[again].astype(np.uint64)) * _MIX[0])
    return flat


#: Masks of the first bytes of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words that eight binary digits can count.
_MOST_COUNTED = 255


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def simhashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Four words of 64 bits per line: the majority of each bit over its features.

    The counters of bits are kept as one array for each of their binary digits; the n-th features of all lines are added at once.
    """
    pieces = -(-sizes // _MOST_COUNTED)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(owner)) - np.searchsorted(owner, owner)
    starts, left = (np.cumsum(sizes) - sizes)[owner] + piece * _MOST_COUNTED, np.minimum(sizes[owner] - piece * _MOST_COUNTED, _MOST_COUNTED)
    order = np.argsort(-left, kind="stable")
    starts, owner, digits = starts[order], owner[order], np.zeros((8, 4, len(order)), np.uint64)
    room = np.empty((2, 4 * len(order)), np.uint64)
    for nth, some in enumerate(np.searchsorted(-left[order], -np.arange(int(left.max(initial=0))))):
        carry, both = (x[: 4 * some].reshape(4, some) for x in room)
        carry[0] = flat[starts[:some] + nth]
        for i in range(3):
            carry[i + 1] = _mixed(carry[i] * _MIX[0])
        for digit in digits[: (nth + 1).bit_length(), :, :some]:
            np.bitwise_and(digit, carry, out=both)
            digit ^= carry
            carry, both = both, carry
    # a line of one piece compares its counters with half of its size, from the highest digit on
    over, same = np.zeros((4, len(order)), np.uint64), np.full((4, len(order)), ~np.uint64(0))
    for i in range(7, -1, -1):
        half = np.where(sizes[owner] // 2 >> i & 1, ~np.uint64(0), np.uint64(0))
        over |= same & digits[i] & ~half
        same &= ~(digits[i] ^ half)
    out = np.empty((len(sizes), 4), np.uint64)
    out[owner] = over.T
    cut = np.flatnonzero(pieces[owner] > 1)
    cut = cut[np.argsort(owner[cut], kind="stable")]
    if len(cut):
        ones = sum(np.unpackbits(np.ascontiguousarray(x[:, cut].T).view(np.uint8), axis=1, bitorder="little").astype(np.int64) << i for i, x in enumerate(digits))
        line, first = np.unique(owner[cut], return_index=True)
        out[line] = np.packbits(2 * np.add.reduceat(ones, first, axis=0) > sizes[line, None], axis=1, bitorder="little").view(np.uint64)
    return out.view(np.int64)


def key_words(sizes: np.ndarray, depth: int) -> np.ndarray:
    """The first words of lines that keys of ``depth`` words are made of."""
    return np.where(sizes >= MIN_WORDS, np.minimum(sizes // 5 + depth, FIRST_WORDS + 2 * (depth - 2)), 0)


def first_words(flat: np.ndarray, sizes: np.ndarray, levels: np.ndarray, counted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests of the words that keys are made of, line after line, frequent words coming last, how many each line has, and how many rare ones.

    ``levels`` has the counts of features in ``counted`` lines by their top bits, as eighths of a power of two.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = (np.exp2(levels[flat >> np.uint64(64 - SLOT_BITS)] / 8) - 0.5) / max(1, counted)
    often = np.searchsorted(OFTEN, share).astype(np.uint64)
    flat = _mixed(flat * _MIX[0])
    order = np.argsort(owner.astype(np.uint64) << np.uint64(40) | often << np.uint64(36) | flat >> np.uint64(28))
    rank, many = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner], key_words(sizes, MOST_WORDS)
    rare = np.bincount(owner[often == 0], minlength=len(sizes))
    return flat[order][rank < many[owner]].astype(np.uint32), many, np.minimum(rare, many)


def longer_keys(words: np.ndarray, many: np.ndarray, sizes: np.ndarray, depth: int, key: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of ``depth`` words that add a later word to the given ones, whose last words are at ``last``: key, last, owner."""
    more = np.maximum(0, key_words(sizes, depth)[owner] - 1 - last)
    nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    key, owner, at = np.repeat(key, more), np.repeat(owner, more), np.repeat(last, more) + 1 + nth
    word = words[(np.cumsum(many) - many)[owner] + at].astype(np.uint64)
    return _mixed((_mixed(key * _MIX[0]) + word) * _MIX[0]), at, owner


def pair_keys(words: np.ndarray, many: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of two words of each line: key, last, owner, sorted by owner."""
    owner = np.repeat(np.arange(len(many)), many)
    rank = np.arange(len(words)) - (np.cumsum(many) - many)[owner]
    return longer_keys(words, many, sizes, 2, words.astype(np.uint64), rank, owner)


def home_ranges(words: np.ndarray, many: np.ndarray, sizes: np.ndarray, rare: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What decides the range of each key of ``pair_keys``: its first word if that is rare, so that a line goes to few ranges, else the key."""
    owner = np.repeat(np.arange(len(many)), many)
    rank = np.arange(len(words)) - (np.cumsum(many) - many)[owner]
    more = np.maximum(0, key_words(sizes, 2)[owner] - 1 - rank)
    return np.where(np.repeat(rank < rare[owner], more), _mixed(np.repeat(words, more).astype(np.uint64) * _MIX[0]), key)


def word_blocks(flat: np.ndarray, sizes: np.ndarray, levels: np.ndarray, counted: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of two words (sorted by line) and how many each line has."""
    key, _, owner = pair_keys(*first_words(flat, sizes, levels, counted)[:2], sizes)
    return key.view(np.int64), np.bincount(owner, minlength=len(sizes))


def _texts(batches: Iterator[pa.RecordBatch], step: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part["doc"].to_pylist(), [x.as_py() or b"" for x in part["text"].cast(pa.binary())]
    give_back()


def word_counts(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(doc, text) to the levels of features (see first_words) and the lines counted."""

    def run(batches):
        counts, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for _, _, texts in _texts(batches, FEW_TEXTS):
            found = [w for t in texts for w in map(line_words, t.split(b"\n")) if len(w) >= MIN_WORDS]
            n += len(found)
            slots = line_features(*word_digests(found)) >> np.uint64(64 - SLOT_BITS)
            counts += np.bincount(slots.astype(np.int64), minlength=len(counts))
        # planes of bytes: the higher ones are almost empty and travel as next to nothing
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in counts.reshape(COUNT_SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNT_SLICES), pa.int32()), pa.array([n, *[0] * (COUNT_SLICES - 1)]), pa.array(planes, pa.binary())], ["slice", "n", "counts"])

    def total(group, t):
        counts = sum(np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in t["counts"])
        levels = np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)
        return pa.table({"slice": pa.array([group[0].as_py()], pa.int32()), "n": pa.array([int(np.asarray(t["n"]).sum())]), "levels": pa.array([levels.tobytes()], pa.binary())})

    sums = small_batches(rows).mapInArrow(run, "slice int, n long, counts binary").groupBy("slice").applyInArrow(total, "slice int, n long, levels binary").toArrow().sort_by("slice")
    if not sums.num_rows:
        return np.zeros(1 << SLOT_BITS, np.uint8), 0
    return np.frombuffer(b"".join(sums["levels"].to_pylist()), np.uint8), sum(sums["n"].to_pylist())


def hashed_lines(rows: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc, text) to doc, line, key, n, sim to sim4, words, rare: a row per line of ``least`` words.

    Lines of fewer than MIN_WORDS words have no words for keys.
    """
    levels, counted = word_counts(rows)

    def run(batches):
        for _, docs, texts in _texts(batches):
            doc, line, key, made = [], [], [], []
            for at in range(0, len(texts), FEW_TEXTS):
                found = []
                for d, t in zip(docs[at : at + FEW_TEXTS], texts[at : at + FEW_TEXTS]):
                    for i, x in enumerate(t.split(b"\n")):
                        w = line_words(x)
                        if len(w) >= least:
                            doc.append(d)
                            line.append(i)
                            key.append(line_key(w))
                            found.append(w)
                made.append(word_digests(found))
            if doc:
                flat, sizes = (np.concatenate(x) for x in zip(*made))
                flat = line_features(flat, sizes)
                sims = simhashes(flat, sizes)
                first, many, rare = first_words(flat, sizes, levels, counted)
                words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(first.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(key, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(sims[:, i].copy()) for i in range(4)), words, pa.array(rare, pa.int32())],
                    ["doc", "line", "key", "n", *SIMS, "words", "rare"],
                )

    return small_batches(rows).mapInArrow(run, "doc long, line int, key long, n int, sim long, sim2 long, sim3 long, sim4 long, words array<int>, rare int")


def shared_buckets(lines: DataFrame, ranges: int, depth: int = 2) -> DataFrame:
    """(key, n, sim, sim2, words, rare) to key, a, b, n, sim, last: pairs near each other (a, b), and the members (a) of large buckets.

    Of members ``last`` has the place of the key's last word if the bucket is to be split, else null. From a
    ``depth`` of three words on, ``up`` (key, last) lists the buckets to split. A line travels once to each
    range that has one of its keys; those of a rare first word have one range, so ranges don't multiply with
    the keys. Without ``sim2`` pairs are held to the first 64 bits, without ``rare`` each key has its own range.
    """
    look = [c for c in _LOOK if c in lines.columns]

    def keys_of(cut):
        words, many = np.asarray(cut["words"].flatten()).view(np.uint32), np.asarray(cut["words"].value_lengths())
        sizes = np.asarray(cut["n"])
        if depth == 2:
            key, last, owner = pair_keys(words, many, sizes)
            rare = np.asarray(cut["rare"]) if "rare" in cut.schema.names else np.zeros(len(sizes), np.int32)
            return key, last, owner, home_ranges(words, many, sizes, rare, key)
        up = cut["up"].flatten()
        owner = np.repeat(np.arange(cut.num_rows), np.asarray(cut["up"].value_lengths()))
        key, last, owner = longer_keys(words, many, sizes, depth, np.asarray(up.field("key")).view(np.uint64), np.asarray(up.field("last")), owner)
        return key, last, owner, key

    def send(batches):
        for batch in batches:
            for from_ in range(0, batch.num_rows, 20_000):
                cut = batch.slice(from_, 20_000)
                cut = cut.take(pa.array(np.unique(np.asarray(cut["key"]), return_index=True)[1]))  # equal lines once
                key, last, owner, home = keys_of(cut)
                part = ((home >> np.uint64(32)).astype(np.int64) * ranges) >> 32
                order = np.lexsort((owner, part))
                key, last, owner = key[order].astype(np.uint32), last[order].astype(np.uint8), owner[order]
                edges = np.searchsorted(part[order], np.arange(ranges + 1))
                parts = [p for p in range(ranges) if edges[p] < edges[p + 1]]
                values, rows = [np.asarray(cut[c]) for c in look], []
                for p in parts:
                    here = slice(edges[p], edges[p + 1])
                    own = owner[here]
                    new = np.append(True, own[1:] != own[:-1])  # owners are in order
                    used = own[new]
                    rows.append([key[here].tobytes(), np.packbits(new).tobytes(), last[here].tobytes(), *(x[used].tobytes() for x in values)])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows))] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * (3 + len(look))], ["part", "block", "new", "last", *look])

    def near(x, y, length, sim, most=BITS_APART):
        fits = PER[1] * np.minimum(length[x], length[y]) >= PER[0] * np.maximum(length[x], length[y])
        return fits & (np.bitwise_count((sim[x] ^ sim[y]).view(np.uint64)) <= most)

    def crowded(x, y, alike, v):
        """Which pairs are inside one crowd, and the members of crowds: their crowd's name, by its members alone, and place."""
        at, root = rooted(x[alike], y[alike])
        order = np.argsort(root, kind="stable")
        at, root = at[order], root[order]
        first = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])) if len(root) else np.empty(0, np.int64)
        many = np.diff(np.append(first, len(root)))
        name = np.repeat(_mixed(np.add.reduceat(_mixed(v[at].view(np.uint64) * _MIX[0]), first) + many.astype(np.uint64)), many) if len(root) else np.empty(0, np.uint64)
        big = np.repeat(many > CROWDED, many)
        home = np.full(int(max(x.max(), y.max())) + 1, -1)
        home[at[big]] = root[big]
        return (home[x] >= 0) & (home[x] == home[y]), (name[big].view(np.int64), at[big])

    def meet(group, t):
        kinds = (np.uint32, np.uint8, np.uint8, np.int64, np.int32, np.int64, np.int64)
        rows = [[np.frombuffer(x, k) for x, k in zip(r, kinds)] for r in zip(*(t[c].to_pylist() for c in ("block", "new", "last", *look)))]
        key, last = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows])
        at = [np.cumsum(np.unpackbits(r[1], count=len(r[0])), dtype=np.int64) - 1 for r in rows]
        v, length, *sims = (np.concatenate([r[i][x] for r, x in zip(rows, at)]) for i in range(3, 3 + len(look)))
        order = np.lexsort((v, key))
        key, last, v, length, *sims = (x[order] for x in (key, last, v, length, *sims))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (v[1:] != v[:-1])])
        key, last, v, length, *sims = (x[new] for x in (key, last, v, length, *sims))
        sim = sims[0]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        keep, linked = np.repeat(size > ALL_PAIRS, size), np.full(len(key), depth == MOST_WORDS)
        for from_, many in zip(start[size > ALL_PAIRS], size[size > ALL_PAIRS]) if depth < MOST_WORDS else ():
            every = np.arange(from_, from_ + many)
            linked[every] = near(every[:, None], every[np.linspace(0, many - 1, HUBS).astype(int)], length, sim, ALIKE_BITS).mean(axis=0).max() >= ALIKE
        pairs, crowds = [], []
        for width in np.unique(size[(size > 1) & (size <= ALL_PAIRS)]):
            at, (i, j) = start[size == width][:, None], np.triu_indices(width, 1)
            step = 1 + 300_000 // len(i)
            for from_ in range(0, len(at), step):
                x, y = (at[from_ : from_ + step] + i).ravel(), (at[from_ : from_ + step] + j).ravel()
                ok = near(x, y, length, sim)
                x, y = x[ok], y[ok]
                if len(sims) > 1:
                    ok = sum(np.bitwise_count((z[x] ^ z[y]).view(np.uint64)) for z in sims) <= HALF_APART
                    x, y = x[ok], y[ok]
                if width > CROWDED and len(x):
                    one, crowd = crowded(x, y, near(x, y, length, sim, ALIKE_BITS), v)
                    x, y = x[~one], y[~one]
                    crowds.append(crowd)
                pairs.append(np.stack([v[x], v[y]], axis=1))
        pairs = np.concatenate([np.empty((0, 2), np.int64), *pairs])
        pairs = pairs[np.lexsort(pairs.T)]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])[: len(pairs)]]
        names, at = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*crowds)) if crowds else (np.empty(0, np.int64),) * 2
        once = np.unique(np.stack([names, v[at]], axis=1), axis=0, return_index=True)[1]
        keep, linked = np.concatenate([np.flatnonzero(keep), at[once]]), np.concatenate([linked[keep], np.ones(len(once), bool)])
        n, none = len(pairs), pa.nulls(len(keep), pa.int64())
        tag = group[0].as_py() << 32
        bucket = np.concatenate([tag | key[keep[: len(keep) - len(once)]], names[once]])
        out = {"key": (pa.nulls(n, pa.int64()), bucket), "a": (pairs[:, 0], v[keep]), "b": (pairs[:, 1], none), "n": (pa.nulls(n, pa.int32()), length[keep]), "sim": (pa.nulls(n, pa.int64()), sim[keep]), "last": (pa.nulls(n, pa.int32()), pa.array(last[keep].astype(np.int32), mask=linked))}
        return pa.table({c: pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x) for x in both]) for c, both in out.items()})

    sent = small_batches(lines).mapInArrow(send, ", ".join(["part int", *(f"{c} binary" for c in ("block", "new", "last", *look))]))
    return sent.groupBy("part").applyInArrow(meet, "key long, a long, b long, n int, sim long, last int")


def _place_spots(doc: np.ndarray, line: np.ndarray, width: int) -> list[np.ndarray]:
    """Two of ``1 << width`` bits for each place (doc, line)."""
    x = _mixed(_mixed(doc.astype(np.int64).view(np.uint64) * _MIX[0]) + line.astype(np.uint64) * _MIX[0])
    return [(_mixed(x * m) >> np.uint64(64 - width)).astype(np.int64) for m in _MIX]


def place_bits(places: DataFrame) -> np.ndarray:
    """A bitmap of the places (doc, line) of a stored table: those that have both their bits are wanted, of others about one in 70 or fewer."""
    width = max(SLICE_BITS, int(places.count() * PLACE_BITS).bit_length())

    def send(batches):
        for batch in batches:
            spots = np.unique(np.concatenate(_place_spots(np.asarray(batch["doc"]), np.asarray(batch["line"]), width)))
            part, first = np.unique(spots >> SLICE_BITS, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([x.astype(np.uint16).tobytes() for x in np.split(spots, first[1:])] if len(part) else [], pa.binary())], ["part", "spots"])

    def meet(group, t):
        found = np.zeros(1 << SLICE_BITS, bool)
        for x in t["spots"]:
            found[np.frombuffer(x.as_buffer(), np.uint16)] = True
        return pa.table({"part": pa.array([group[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros((1 << width - SLICE_BITS, 1 << SLICE_BITS - 3), np.uint8)
    for r in places.mapInArrow(send, "part int, spots binary").groupBy("part").applyInArrow(meet, "part int, bits binary").toArrow().to_pylist():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def coded_lines(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc, text) to v, code: each line at a place of ``place_bits``, and few others, with a character for every word.

    The texts stay where they are: what travels is the bitmap, two bytes a place.
    """
    width = (len(bits) * 8).bit_length() - 1

    def run(batches):
        for _, docs, texts in _texts(batches):
            split = [t.split(b"\n") for t in texts]
            many = np.array([len(x) for x in split], np.int64)
            line = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            hit = np.logical_and.reduce([bits[x >> 3] >> (x & 7) & 1 for x in _place_spots(np.repeat(np.array(docs, np.int64), many), line, width)])
            every = list(chain.from_iterable(split))
            found = [w for w in (line_words(every[i]) for i in np.flatnonzero(hit)) if len(w) >= MIN_WORDS]
            flat, sizes = word_digests(found)
            letters = (flat % np.uint64(0x100000) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")
            stops = np.cumsum(sizes).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([line_key(w) for w in found], pa.int64()), pa.array([letters[a:b] for a, b in zip([0, *stops], stops)], pa.string())], ["v", "code"])

    return small_batches(rows).mapInArrow(run, "v long, code string")


def line_groups(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """id, root: the connected groups of distinct lines (line keys); lines without a link are absent."""
    long = lines.where(F.col("n") >= MIN_WORDS)
    pairs = F.least(F.floor(F.col("n") / 5) + 2, F.lit(FIRST_WORDS))
    entries = long.agg(F.sum((pairs * (pairs - 1) / 2).cast("long"))).first()[0] or 0
    found = stored(shared_buckets(long.select("key", "n", "sim", "sim2", "words", "rare"), entries // RANGE_ENTRIES + 8), "line-buckets")
    split, known = found.where("last is not null"), None
    for depth in range(3, MOST_WORDS + 1):
        entries = split.count() * FIRST_WORDS
        if not entries:
            break
        up = stored(split.groupBy(F.col("a").alias("key")).agg(F.collect_list(F.struct("key", "last")).alias("up")), "line-splits")
        if known is None:  # later splits are of the same lines
            few = long.select("key", "n", "sim", "sim2", "words").join(small(up.select("key"), ID_ROWS), "key", "left_semi")
            known = stored(few.dropDuplicates(["key"]), "line-words")
        deeper = stored(shared_buckets(known.join(up, "key"), entries // RANGE_ENTRIES + 8, depth), "line-buckets")
        found, split = found.where("last is null").union(deeper), deeper.where("last is not null")
    near = found.where("b is not null").select("a", "b").distinct()
    members = found.where("b is null").select("key", F.col("a").alias("v"), F.struct("n", "sim", F.lit(0).cast("long").alias("lead")).alias("d")).distinct()
    ids = found.select(F.explode(F.array("a", "b")).alias("key")).where("key is not null").distinct()
    wanted = long.select("key", "doc", "line", "n", *SIMS).join(small(stored(ids, "line-ids"), ID_ROWS), "key", "left_semi")
    wanted = stored(wanted.groupBy("key").agg(F.min(F.struct("doc", "line", F.struct("n", *SIMS).alias("look"))).alias("at")), "line-looks")
    looks = wanted.select(F.col("key").alias("v"), F.col("at.look").alias("look"))

    def alike(x: str, y: str, sims: list[str], apart: int) -> Column:
        longer, shorter = F.greatest(f"{x}.n", f"{y}.n"), F.least(f"{x}.n", f"{y}.n")
        bits = sum(F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in sims)
        return (PER[1] * shorter >= PER[0] * longer) & (bits <= apart)

    def close(x: str, y: str) -> Column:
        return alike(x, y, SIMS[:1], BITS_APART)

    def closer(x: str, y: str) -> Column:
        return alike(x, y, SIMS, WIDE_APART)

    def equal(x: Column, y: Column) -> Column:
        # a bound on the distance narrows the table of the edit distance; most pairs are far closer than allowed
        most = F.floor(F.greatest(F.length(x), F.length(y)) * (PER[1] - PER[0]) / PER[1]).cast("int")
        within = lambda bound: F.call_function("levenshtein", x, y, bound) >= 0
        return within(F.least(F.lit(8), most)) | within(most)

    def refine(few: DataFrame) -> DataFrame:
        return few.join(looks, "v").join(codes, "v").select("v", F.struct("look.*", "code").alias("e"))

    def sure(x: str, y: str) -> Column:
        """The whole test inside the last join: lines near each other but not similar enough give no rows for their pairs."""
        return equal(F.col(f"{x}.code"), F.col(f"{y}.code"))

    def side(table: DataFrame, c: str, n: str) -> DataFrame:
        return table.select(F.col("v").alias(n), F.col(c).alias(f"{c}{n}"))

    def likely(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(side(looks, "look", "a"), "a").join(side(looks, "look", "b"), "b").where(closer("looka", "lookb")).select("a", "b"), "likely")

    near = likely(near)
    used = near.select(F.explode(F.array("a", "b")).alias("key")).union(members.select(F.col("v").alias("key"))).distinct()
    used = wanted.join(small(stored(used, "line-used"), ID_ROWS), "key", "left_semi")
    places = stored(used.select("at.doc", "at.line"), "line-places")
    # a line may be found at some place more
    codes = stored(coded_lines(rows, place_bits(places)).groupBy("v").agg(F.first("code").alias("code")), "line-codes")

    def equal_enough(some: DataFrame) -> DataFrame:
        """Of stored likely pairs those of which the edit distance says so; only their lines' codes are shuffled."""
        need = stored(some.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "line-needed")
        few = codes.join(small(need, ID_ROWS), "v", "left_semi")
        both = some.join(side(few, "code", "a"), "a").join(side(few, "code", "b"), "b")
        return both.where(equal(F.col("codea"), F.col("codeb"))).select("a", "b")

    linked = link_buckets(members, close, lambda pairs: equal_enough(likely(pairs)), refine, closer, sure).select(F.col("id").alias("a"), F.col("root").alias("b"))
    return components(equal_enough(near).union(linked))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """``df`` with ``text`` rid of repeated lines, n_lines and n_removed (long).

    ``short``: exact repeats of lines of fewer than MIN_WORDS words go too.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    lines = stored(hashed_lines(rows, 1 if short else MIN_WORDS), "lines")
    labels = stored(line_groups(rows, lines).where("id <> root"), "line-groups")
    grouped = lines.join(small(labels, ID_ROWS), F.col("key") == F.col("id"), "left").select("doc", "line", F.coalesce("root", "key").alias("grp"))
    first = grouped.groupBy("grp").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").select("grp", "first")
    later = grouped.join(small(stored(first, "line-firsts"), ID_ROWS), "grp").where(F.struct("doc", "line") != F.col("first"))
    gone = stored(later.groupBy("doc").agg(F.collect_set("line").alias("_gone")), "line-removals").withColumnRenamed("doc", "_doc")
    held = gone.agg(F.sum(F.size("_gone") * 4 + 64)).first()[0] or 0
    if held <= REMOVED_BYTES:
        gone = F.broadcast(gone)
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    out = df.withColumn("_id", F.col(key).cast("long")).join(gone, F.col("_id") == F.col("_doc"), "left")
    counts = {"n_lines": F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}
    out = out.withColumns({c: F.when(F.col(text).isNull() | (v < 0), 0).otherwise(v).cast("long") for c, v in counts.items()})
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_id", "_doc", "_gone")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
