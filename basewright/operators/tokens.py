"""Pieces, k-mers, vocabularies and encoders (C7, C8, C28, C30, C31, D)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions import dna

# Ids of the special tokens and of the bases, and the ignored label.
PAD, UNK, CLS, SEP, MASK = 0, 1, 2, 3, 4
BASE_IDS = {"A": 5, "C": 6, "G": 7, "T": 8, "N": 9}
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
IGNORE = -100


def contig_pieces(df: DataFrame, min_length: int, name: str = "record_idx") -> DataFrame:
    """Pieces between runs of N of at least ``min_length``; a suffix only where there were several."""
    pieces = df.withColumn("_p", dna.split_on_n(F.col("seq")))
    rows = pieces.select("*", F.posexplode("_p").alias("piece_idx", "piece")).where(F.length("piece") >= min_length)
    label = F.concat(F.col(name).cast("string"), F.lit("_chunk_"), F.col("piece_idx").cast("string"))
    return rows.withColumn("name", F.when(F.size("_p") > 1, label).otherwise(F.col(name).cast("string"))).drop("_p")


def long_chunks(df: DataFrame, size: int = 10_000_000, min_length: int = 1, name: str = "record_idx") -> DataFrame:
    """Chunks of at most ``size`` bases; a short tail goes."""
    n = F.length("seq")
    rows = df.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("start"))
    rows = rows.withColumn("stop", F.least(F.col("start") + size, n)).where(F.col("stop") - F.col("start") >= min_length)
    label = F.concat_ws("_", F.col(name).cast("string"), F.col("start"), F.col("stop"))
    return rows.withColumn("chunk", F.substring("seq", F.col("start") + 1, F.lit(size))).withColumn("name", F.when(n > size, label).otherwise(F.col(name).cast("string")))


def kmer_rows(df: DataFrame, k: int, with_n: bool = False) -> DataFrame:
    """C11: one row per overlapping k-mer (file, record_idx, kmer), by default without those that hold N.

    Sequences are exploded into short overlapping stretches first: cutting at a
    place walks the string up to it. Generators also keep the rest in compiled code.
    """
    size = 2 * dna.STRETCH
    starts = F.sequence(F.lit(1), F.length("seq") - k + 1, F.lit(size))
    parts = df.where(F.length("seq") >= k).select("file", "record_idx", F.explode(F.transform(starts, lambda i: F.substring("seq", i, F.lit(size + k - 1)))).alias("_p"))
    spots = parts.select("file", "record_idx", "_p", F.explode(F.sequence(F.lit(1), F.length("_p") - k + 1)).alias("_i"))
    rows = spots.select("file", "record_idx", F.substring("_p", F.col("_i"), F.lit(k)).alias("kmer"))
    return rows if with_n else rows.where(~F.col("kmer").contains("N"))


def schedule(spark: SparkSession, spec: str) -> DataFrame:
    """``"0:1000,10000:5000"`` as rows (start, every) in order of start."""
    rows = sorted(tuple(int(x) for x in part.split(":")) for part in spec.split(",") if part.strip())
    if any(s < 0 or e <= 0 for s, e in rows):
        raise ValueError("starts must not be negative and intervals must be positive")
    return spark.createDataFrame(rows, "start long, every long")


def parse_indices(spec: str, n: int) -> list[int]:
    """``all`` or a comma list of indices below ``n``, sorted and distinct."""
    if spec.strip().lower() == "all":
        return list(range(n))
    found = sorted({int(x) for x in spec.split(",") if x.strip()})
    if not found or found[0] < 0 or found[-1] >= n:
        raise ValueError(f"indices must lie between 0 and {n - 1}")
    return found


def base_vocabulary(spark: SparkSession) -> DataFrame:
    """Id, token, base_length of the single-base tokenizer."""
    rows = [(i, t, 0) for i, t in enumerate(SPECIALS)] + [(i, b, 1) for b, i in BASE_IDS.items()]
    return spark.createDataFrame(rows, "id int, token string, base_length int")


def corpus_sample(df: DataFrame, limit: int) -> DataFrame:
    """Sequences in (file, record_idx) order until ``limit`` bases; the crossing one is cut.

    Offsets come from sums per file, so no task orders the whole corpus.
    """
    rows = df.withColumn("_n", F.length("seq"))
    files = rows.groupBy("file").agg(F.sum("_n").alias("_t"))
    w = Window.orderBy("file")  # one row a file
    starts = files.select("file", (F.sum("_t").over(w) - F.col("_t")).alias("_f"))
    inside = Window.partitionBy("file").orderBy("record_idx")
    rows = rows.join(starts, "file").withColumn("_before", F.col("_f") + F.sum("_n").over(inside) - F.col("_n"))
    left = F.lit(limit) - F.col("_before")
    return rows.where((left > 0) & (F.col("_n") > 0)).withColumn("seq", F.substring("seq", F.lit(1), left.cast("int"))).drop("_n", "_f", "_before")


def kmer_counts(df: DataFrame, k: int = 6) -> DataFrame:
    """Kmer, n, and rank by (-n, kmer)."""
    rows = kmer_rows(df, k).groupBy("kmer").agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "kmer")))  # at most 4^k rows


def build_vocabulary(counts: DataFrame, size: int = 4096) -> DataFrame:
    """D3: id, token, merge_rank, left, right from six-mer counts (kmer, n).

    Specials, bases, all words of 2 to 5 bases level by level, then six-mers by
    (-count, word) and the uncounted ones in order. A merge joins a word's
    prefix and its last base. Ids and ranks are functions of the words, so only
    the six-mers need an order, over at most 4^6 rows.
    """
    if size < 10:
        raise ValueError("a vocabulary has at least 10 tokens")
    spark = counts.sparkSession
    base = F.array(*map(F.lit, "ACGT"))
    level = spark.range(1).select(F.explode(base).alias("token"))
    words = None
    for k in range(2, 7):
        level = level.select("token", F.explode(base).alias("base")).select(F.concat("token", "base").alias("token"))
        words = level if words is None else words.unionByName(level)
    ranked = words.join(counts.select(F.col("kmer").alias("token"), "n"), "token", "left")
    six = F.length("token") == 6
    order = Window.orderBy(F.length("token"), F.when(six, -F.coalesce("n", F.lit(0))).otherwise(0), "token")
    made = ranked.withColumn("id", (F.row_number().over(order) + 9).cast("int")).where(F.col("id") < size)
    made = made.select("id", "token", (F.col("id") - 10).alias("merge_rank"), F.expr("substring(token, 1, length(token) - 1)").alias("left"), F.expr("right(token, 1)").alias("right"))
    return base_vocabulary(spark).select("id", "token", F.lit(None).cast("int").alias("merge_rank"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right")).unionByName(made)


def merge_pairs(seq: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The pair of lowest rank merges first, the leftmost on ties, until none is left."""
    parts = list(seq)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i] = a + b
        parts[j] = ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [p for p in parts if p]


ENCODING = "input_ids array<int>, starts array<int>, ends array<int>"


def bpe_encoder(vocabulary: list[tuple[int, str, int | None, str | None, str | None]], specials: bool = True):
    """A Column function from sequences to struct(input_ids, starts, ends) for vocabulary rows.

    A vocabulary is bounded by its size, so it travels with the function.
    """
    ids = {t: i for i, t, *_ in vocabulary}
    ranks = {(a, b): r for _, _, r, a, b in vocabulary if r is not None}

    @F.pandas_udf(ENCODING)
    def encode(seqs: pd.Series) -> pd.DataFrame:
        rows = []
        for s in seqs:
            tokens = merge_pairs(s or "", ranks)
            out, starts, ends, at = [], [], [], 0
            for t in tokens:
                out.append(ids.get(t, UNK))
                starts.append(at)
                at += len(t)
                ends.append(at)
            rows.append(([CLS, *out, SEP], [0, *starts, 0], [0, *ends, 0]) if specials else (out, starts, ends))
        return pd.DataFrame(rows, columns=["input_ids", "starts", "ends"])

    return encode


def base_ids(seq: Column) -> Column:
    """The ids of single bases."""
    symbols = F.split(seq, "")
    return F.transform(F.filter(symbols, lambda c: c != ""), lambda c: F.instr(F.lit("ACGTN"), c) + 4)


def encode_base(seq: Column, max_length: int | None = None, pad: bool = False, specials: bool = True) -> Column:
    """struct(input_ids, attention_mask, starts, ends) of a normalised sequence.

    Too long: cut, and the last id becomes SEP with offset (0, 0). ``pad`` fills up to ``max_length``.
    """
    one, zero = F.array(F.lit(1)), F.array(F.lit(0))
    n = F.length(seq)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = {"input_ids": base_ids(seq), "attention_mask": F.array_repeat(F.lit(1), n), "starts": at, "ends": F.transform(at, lambda i: i + 1)}
    ends = {"input_ids": (F.array(F.lit(CLS)), F.array(F.lit(SEP)), PAD), "attention_mask": (one, one, 0), "starts": (zero, zero, 0), "ends": (zero, zero, 0)}
    out = []
    for name, col in parts.items():
        first, last, fill = ends[name]
        if specials:
            col = F.concat(first, col, last)
            if max_length is not None:
                col = F.when(n + 2 > max_length, F.concat(F.slice(col, 1, max_length - 1), last)).otherwise(col)
        elif max_length is not None:
            col = F.slice(col, 1, max_length)
        if pad and max_length is not None:
            col = F.concat(col, F.array_repeat(F.lit(fill), F.greatest(F.lit(max_length) - F.size(col), F.lit(0))))
        out.append(col.alias(name))
    return F.struct(*out)


def kmer_channel(seq: Column, starts: Column, ends: Column, k: int, target: int | None = None, within_token: bool = False) -> Column:
    """K-mer id at each token: k bases from its offset, or its own first k bases; 0 for specials and tails."""
    n = F.length(seq)
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))

    def one(ids: Column, o: Column) -> Column:
        fits = (o["e"] > o["s"]) & (o["s"] + k <= (o["e"] if within_token else n))
        return F.when(fits, F.get(ids, o["s"])).otherwise(0)

    out = dna.bind(F.transform(dna.kmers(seq, k), dna.kmer_id), lambda ids: F.transform(spans, lambda o: one(ids, o)))
    if target is None:
        return out
    return F.concat(F.slice(out, 1, target), F.array_repeat(F.lit(0), F.greatest(F.lit(target) - F.size(out), F.lit(0))))


def decode_base(ids: Column) -> Column:
    """The bases of an id array; special ids are skipped."""
    letters = F.array(*map(F.lit, "ACGTN"))
    return F.array_join(F.transform(F.filter(ids, lambda i: i > MASK), lambda i: F.get(letters, i - 5)), "")


def decode_with(ids: Column, tokens: list[str]) -> Column:
    """The same for a vocabulary given as its tokens in id order."""
    words = F.array(*map(F.lit, tokens))
    return F.array_join(F.transform(F.filter(ids, lambda i: i > MASK), lambda i: F.get(words, i)), "")


def token_store(df: DataFrame, k: int = 3) -> DataFrame:
    """File, record_idx, input_ids, kmer_ids, n_tokens, token_start, token_end; no specials, no padding.

    Token offsets are contiguous within a file, in record order.
    """
    enc = encode_base(F.col("seq"), specials=False)
    rows = df.select("file", "record_idx", "seq", enc.alias("_e"))
    rows = rows.select("file", "record_idx", F.col("_e.input_ids").alias("input_ids"), kmer_channel(F.col("seq"), F.col("_e.starts"), F.col("_e.ends"), k).alias("kmer_ids"), F.length("seq").alias("n_tokens"))
    end = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("record_idx"))
    return rows.withColumn("token_end", end).withColumn("token_start", F.col("token_end") - F.col("n_tokens"))


def strand_diagnostics(df: DataFrame, k: int = 3) -> DataFrame:
    """Per record the token length difference between strands and the share of equal ids and k-mers after reversal."""
    both = df.select("record_idx", F.col("seq").alias("s"), dna.reverse_complement(F.col("seq")).alias("r"))
    both = both.select("*", *[encode_base(F.col(c), specials=False).alias(f"e{c}") for c in "sr"])
    channel = lambda c: kmer_channel(F.col(c), F.col(f"e{c}.starts"), F.col(f"e{c}.ends"), k)
    rows = both.select("record_idx", F.col("es.input_ids").alias("ids"), F.reverse("er.input_ids").alias("rids"), channel("s").alias("kmers"), F.reverse(channel("r")).alias("rkmers"))

    def share(x: str, y: str) -> Column:
        same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.lit(0), lambda t, v: t + v)
        return F.coalesce(same / F.nullif(F.greatest(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))

    return rows.select("record_idx", F.abs(F.size("ids") - F.size("rids")).alias("length_diff"), share("ids", "rids").alias("id_match"), share("kmers", "rkmers").alias("kmer_match"))


def _kmer_tally(k: int):
    """How often each of the 4^k k-mers occurs, in order of their base-4 numbers: one pass over a sequence."""
    digit = np.full(256, -1, np.int64)
    digit[list(dna.BASES.encode())] = range(4)

    @F.pandas_udf("array<int>")
    def run(seqs: pd.Series) -> pd.Series:
        out = []
        for s in seqs:
            found = digit[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
            n = max(0, len(found) - k + 1)
            number, known = np.zeros(n, np.int64), np.ones(n, bool)
            for i in range(k):
                part = found[i : i + n]
                number, known = number * 4 + part, known & (part >= 0)
            out.append(np.bincount(number[known], minlength=4**k).astype(np.int32))
        return pd.Series(out)

    return run


def kmer_features(df: DataFrame, k: int = 3) -> DataFrame:
    """File, record_idx, length, gc, and ``freqs``: 4^k k-mer shares in order; ambiguous ones count in the denominator."""
    total = F.greatest(F.length("seq") - k + 1, F.lit(1))
    freqs = F.transform(_kmer_tally(k)(F.col("seq")), lambda n: n / total)
    return df.select("file", "record_idx", F.length("seq").alias("length"), dna.fraction_of(F.col("seq"), "GC").alias("gc"), freqs.alias("freqs"))


def tokenizer_kind(name: str) -> str:
    """The canonical name of a tokenizer type."""
    key = name.strip().lower().replace("-", "_")
    if key in ("bpe", "dna_bpe"):
        return "bpe"
    if key in ("base", "single_base", "nucleotide", "char"):
        return "base"
    raise ValueError(f"unknown tokenizer type: {name}")


def tokenizer_metadata(kind: str, tokens: list[str], k: int) -> dict:
    """M8: what two token stores must share to be compatible."""
    import hashlib

    digest = hashlib.sha256("\n".join(tokens).encode()).hexdigest()
    return {"format_version": 1, "type": tokenizer_kind(kind), "vocab_size": len(tokens), "vocab_sha256": digest, "kmer_size": k, "kmer_vocab_size": 4**k + 1, "special_ids": [PAD, UNK, CLS, SEP, MASK]}


def check_compatible(found: dict, wanted: dict) -> None:
    """Raise on the first differing entry."""
    for key, value in wanted.items():
        if found.get(key) != value:
            raise ValueError(f"token store does not fit: {key} is {found.get(key)!r}, not {value!r}")
