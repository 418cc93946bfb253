"""Substring dedup by factors cut at minimizer anchors, against indexed reference blocks.

All texts are reference blocks. Their factors, runs of windows that share an
anchor, go into a distributed index (see repeats.py). This stands in for a
greedy relative Lempel-Ziv parse: no longest match is sought from a position.
Each factor of a document is looked up whole, and a factor that another
place has becomes part of a duplicate span at once, neighbouring ones growing
into one long copy. Around the boundaries, where an indexed factor with the
same anchor differs, the windows are checked one by one against every
different factor of that anchor. So a word belongs to a duplicate span exactly
if a window of ``length`` words around it occurs elsewhere.

Edge cases: null and wordless texts have no words and lose none; texts shorter
than a window lose none; a window that repeats inside its own text counts;
rows with a null id are left as they are; rows that repeat an id must repeat
its text, and then count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import small_batches, table
from basewright.llm.repeats import Powers, _groups, covered, repeated_windows

LENGTH, GRAM = 35, 8
#: Word digests that a task keeps.
CACHE = 300_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        d = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return d


def word_symbols():
    """A function from a text to the digests of its words."""
    digests = _Words()
    return lambda text: np.array([digests[w] for w in text.split()], np.uint64)


def _same_windows(docs, anchors, counts, content) -> np.ndarray:
    """Flags of windows that occur twice among the factors of one anchor."""
    digests = np.frombuffer(content, np.uint64)
    order, new = _groups(digests, np.repeat(anchors, counts))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    flags = np.empty(len(order), bool)
    flags[order] = np.repeat(size > 1, size)
    return flags


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: key, n_words, n_removed, spans (start, stop of removed words), kept (remaining words, one space between)."""
    gram = min(GRAM, length)
    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    content = lambda raw, runs, run: runs.windows(run, length).tobytes()
    found = repeated_windows(rows, word_symbols, gram, length, False, content, _same_windows, lambda counts, data: np.frombuffer(data, np.uint64), 8 * (length - gram + 1) // 2)

    def cut(batches):
        sym, powers = word_symbols(), Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for raw, runs, starts in zip(part["text"].cast(pa.binary()), part["runs"].to_pylist(), part["starts"].to_pylist()):
                    words = (raw.as_py() or b"").split()
                    if not runs and not starts:
                        out.append((len(words), 0, [], b" ".join(words)))
                        continue
                    gone = covered(sym(b" ".join(words)), gram, length, powers, runs, starts)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    out.append((len(words), int(gone.sum()), edges.tolist(), b" ".join(w for w, g in zip(words, gone) if not g)))
                cols = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([part["doc"], *cols], ["doc", "n_words", "n_removed", "edges", "kept"])

    out = small_batches(found).mapInArrow(cut, "doc long, n_words long, n_removed long, edges array<long>, kept binary")
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("edges") / 2).cast("int") - 1), lambda i: F.struct(F.get("edges", 2 * i).alias("start"), F.get("edges", 2 * i + 1).alias("stop")))
    spans = F.when(F.size("edges") > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    return out.select(F.col("doc").alias(key), "n_words", "n_removed", spans.alias("spans"), F.decode("kept", "UTF-8").alias("kept"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
