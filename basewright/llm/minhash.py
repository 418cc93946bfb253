"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles, as 64-bit digests. Minima of
130 hash functions are cut into 26 bands of 5: at similarity 0.85 a pair
misses every band once in four million. Of the minima only the low two bits
are kept, packed into two bit planes; the share of equal bit pairs, corrected
for chance, estimates the similarity of a candidate pair, and pairs estimated
more than six standard errors under the threshold are dropped (members of
buckets that stay crowded get a sketch of 2048 minima for that), and so are
pairs whose sizes and shingles of their own (that no other candidate has) rule
the threshold out. The others are confirmed on their full sets.

Documents with equal sets are one vertex. Buckets link to hubs instead of
listing all their pairs (see groups.py).

Edge cases: null, empty and wordless texts have no shingles and no links; a
text of fewer words than a shingle is one shingle; rows that repeat an id are
one document; rows with a null id stay apart, keep themselves and have a null
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import ID_ROWS, give_back, small, small_batches, stored, table
from basewright.llm.groups import link_buckets

BANDS, ROWS, BITS = 26, 5, 2
HASHES = BANDS * ROWS
#: Hash functions of the finer sketch that crowded buckets get.
FINE = 2048
#: Words that a task keeps digests of.
CACHE = 300_000
SIGNATURES = "doc long, n_shingles long, set_hi long, set_lo long, bands array<long>, planes array<long>"
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Digests(dict):
    """64-bit digests of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        d = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return d


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int, digests: dict) -> np.ndarray:
    """The sorted distinct shingle digests of a text, A-Z lower-cased, split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array([digests[w] for w in words], np.uint64)
    n = max(1, len(ids) - width + 1)
    acc = np.full(n, len(ids) if len(ids) < width else 0, np.uint64)
    for j in range(min(width, len(ids))):
        acc = acc * _MIX[0] + ids[j : j + n]
        acc = acc ^ (acc >> np.uint64(29))
    return np.unique(_mix(acc))


def _functions(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(0, 2**63, (2, n), np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, step = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), max(1, 262_144 // len(a))
    for i in range(0, len(values), step):
        np.minimum(out, (values[i : i + step, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
    for j in range(ROWS):
        key = _mix(key + rows[:, j])
    return key.view(np.int64)


def bit_planes(low: np.ndarray) -> np.ndarray:
    bits = _mix(low)
    out = np.zeros((BITS, -(-len(low) // 64) * 64), np.uint8)
    for j in range(BITS):
        out[j, : len(low)] = (bits >> np.uint64(j)).astype(np.uint8) & 1
    return np.packbits(out, axis=1).view(np.int64).ravel()


def _per_text(df: DataFrame, one, schema: str) -> DataFrame:
    """Run ``one(text bytes)`` -> tuple over the rows of (doc, text)."""
    types = [f.dataType for f in df.sparkSession.createDataFrame([], schema).schema]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if t.simpleString().startswith("array") else pa.int64() for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = one()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [state(x.as_py()) for x in part["text"].cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part["doc"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[1:]))], names)
        del state
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc, n_shingles, set_hi, set_lo (digest of the set), bands, planes."""

    def one():
        digests, (a, b) = _Digests(), _functions()

        def of(raw: bytes | None):
            s = shingle_set(raw or b"", width, digests)
            if not len(s):
                return 0, None, None, None, None
            low = minima(s, a, b)
            hi, lo = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            return len(s), int(hi), int(lo), band_keys(low), bit_planes(low)

        return of

    return _per_text(df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")), one, SIGNATURES)


def full_sets(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc, s: the shingle sets as arrays of long."""

    def one():
        digests = _Digests()
        return lambda raw: (shingle_set(raw or b"", width, digests).view(np.int64),)

    return _per_text(df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")), one, "doc long, s array<long>")


def estimate(x: Column, y: Column, hashes: int = HASHES) -> Column:
    """Similarity of two packed signatures: equal bit pairs, corrected for chance."""
    plane = -(-hashes // 64)
    apart = lambda i: F.bit_count(_differ(x, y, i, plane)).cast("int")
    if plane <= 4:
        total = sum((apart(F.lit(i)) for i in range(plane)), F.lit(0))
    else:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(plane - 1)), F.lit(0), lambda n, i: n + apart(i))
    chance = 2.0**-BITS
    return ((hashes - total) / F.lit(float(hashes)) - chance) / (1 - chance)


def _differ(x: Column, y: Column, i: Column, plane: int) -> Column:
    out = None
    for j in range(BITS):
        d = F.get(x, i + j * plane).bitwiseXOR(F.get(y, i + j * plane))
        out = d if out is None else out.bitwiseOR(d)
    return out


def fine_sketches(full: DataFrame) -> DataFrame:
    """(v, s) to v, e: packed bits of ``FINE`` minima."""

    def run(batches):
        a, b = _functions(FINE)
        for batch in batches:
            out = [bit_planes(minima(np.asarray(x, np.int64).view(np.uint64), a, b)) for x in (s.values.to_numpy() for s in batch["s"])]
            yield pa.RecordBatch.from_arrays([batch["v"], pa.array(out, pa.list_(pa.int64()))], ["v", "e"])

    return small_batches(full).mapInArrow(run, "v long, e array<long>")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    sigs = stored(signatures(df, key, text, width), "signatures")
    sets = ["set_hi", "set_lo"]
    classes = stored(sigs.where("n_shingles > 0 and doc is not null").groupBy(*sets).agg(F.min("doc").alias("v")), "classes")
    heads = sigs.join(small(classes.select("v"), ID_ROWS), F.col("doc") == F.col("v"), "left_semi").where("n_shingles > 0")
    banded = heads.select(F.col("doc").alias("v"), F.explode("bands").alias("key"))
    shared = stored(banded.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("key"), "shared")
    some = banded.join(small(shared, ID_ROWS), "key")
    some = stored(some.distinct(), "band-members")
    ids = stored(some.select("v").distinct(), "candidates")
    wanted = df.where(F.col(key).isNotNull()).join(small(ids.withColumnRenamed("v", "_v"), ID_ROWS), F.col(key) == F.col("_v"), "left_semi")
    full = stored(full_sets(wanted, key, text, width).dropDuplicates(["doc"]), "sets")
    # shingles that no other candidate has: they bound the similarity to all of them from above
    own = full.select("doc", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).where("n = 1")
    alone = stored(own.groupBy(F.col("doc").alias("v")).agg(F.count("*").alias("u")), "alone")
    look = heads.select(F.col("doc").alias("v"), F.col("n_shingles").alias("n"), F.col("planes").alias("p")).join(small(ids, ID_ROWS), "v", "left_semi").dropDuplicates(["v"])
    look = look.join(small(alone, ID_ROWS), "v", "left").select("v", F.struct("n", F.coalesce("u", F.lit(0)).alias("u"), "p", F.round(F.coalesce("u", F.lit(0)) * 1e6 / F.col("n")).cast("long").alias("lead")).alias("d"))
    look = stored(look.where(100 * (F.col("d.n") - F.col("d.u")) >= percent * F.col("d.n")), "sketches")
    members = stored(some.join(small(look), "v"), "members")
    share = percent / 100.0

    def least(hashes: int) -> float:
        """Six standard errors under the threshold."""
        p = share + (1 - share) * 2.0**-BITS
        return share - 6 * (p * (1 - p) / hashes) ** 0.5 / (1 - 2.0**-BITS)


    def close(x: str, y: str) -> Column:
        most = F.least(F.col(f"{x}.n") - F.col(f"{x}.u"), F.col(f"{y}.n") - F.col(f"{y}.u"))
        sizes = most * 100 >= F.greatest(F.col(f"{x}.n") + F.col(f"{y}.u"), F.col(f"{y}.n") + F.col(f"{x}.u")) * percent
        return sizes & (estimate(F.col(f"{x}.p"), F.col(f"{y}.p")) >= least(HASHES))

    def closer(x: str, y: str) -> Column:
        return estimate(F.col(x), F.col(y), FINE) >= least(FINE)

    def refine(few: DataFrame) -> DataFrame:
        return fine_sketches(few.join(full.withColumnRenamed("doc", "v"), "v"))

    def confirm(pairs: DataFrame) -> DataFrame:
        side = lambda n: full.select(F.col("doc").alias(n), F.col("s").alias(f"s{n}"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    labels = link_buckets(members, close, confirm, refine, closer)
    rows = sigs.select("doc", "n_shingles", *sets).join(classes, sets, "left")
    rows = rows.join(small(labels, ID_ROWS), F.col("v") == F.col("id"), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("root", "v", "doc"))
    return rows.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
