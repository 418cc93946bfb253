"""SentencePiece encoding and decoding as a relational lattice.

The pieces and scores of a model file form a table. A text is cut into words
(spaces and what follows them; line feeds stand alone), and these further
between any two characters that stand together in no piece: no piece crosses
such a cut, so the best paths of the parts make up that of the text. Distinct
parts ("words" from here on) are exploded into their substrings of bounded
length, joined to the piece table on the substring, and grouped by word again:
the edges of its lattice, packed in longs. A fold over the edges keeps the best
score to each end (Viterbi, by higher-order functions); walking the back
pointers gives the ids. Characters without a piece become byte pieces. Of equal
scores the longer last piece wins.

A word of more than ``LONG`` characters would make one array of all its edges,
which the fold copies in each step; such words take the same recurrence in
Python, where they are cut, in linear time.

The scores are taken as additive weights also for a model whose own encoder
merges pairs; ids then decode to the same text, but may cut words elsewhere
than pair merging would.

Edge cases: null text has null ids; an empty text has none; ids of all
texts decode to the text again; texts without spaces and of any length are
encoded whole; an empty table gives an empty result; repeated rows repeat their
ids; extra columns are carried along, but for one named ``ids``, which the
result replaces.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from basewright.llm.common import give_back, let, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A word with the spaces before it, the spaces at the end of a line, or a line feed.
WORD = r"\n| *[^ \n]+| +"
#: Added to the least score for each byte of a character without a piece.
BYTE_PENALTY = -10.0
#: Characters of a block of rows, and text bytes of a part of the words.
BLOCK_CHARS, PART_BYTES = 8 << 20, 4 << 20
#: Characters up to which a word goes through the relational lattice.
LONG = 256
#: Bits of a packed edge below its end, and below its start.
_STOP, _START = 40, 20


@dataclass
class Model:
    pieces: list[tuple[str, int, float]]
    bytes_at: int
    hexes: list[str]
    longest: int
    byte_score: float
    #: Scores by id; behind the ids those of a character of 0, 1, … bytes without a piece.
    scores: list[float]
    #: Pairs of characters that some piece has.
    pairs: set[str]
    #: The id of each piece, with plain spaces.
    ids: dict[str, int]


@cache
def load_model(path: str = MODEL) -> Model:
    """The piece table of a model file with byte fallback."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, hexes, bytes_at = [], [], None
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at = i if bytes_at is None else bytes_at
            hexes.append(piece[3:5])
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            hexes.append("")
        else:
            pieces.append((piece, i, sp.get_score(i)))
            hexes.append(piece.replace(SPACE, " ").encode().hex().upper())
    if bytes_at is None:
        raise ValueError("the model has no byte pieces")
    byte_score = min(s for _, _, s in pieces) + BYTE_PENALTY
    scores = [0.0] * n + [k * byte_score for k in range(5)]
    for _, i, s in pieces:
        scores[i] = s
    plain = [p.replace(SPACE, " ") for p, _, _ in pieces]
    pairs = {a + b for p in plain for a, b in zip(p, p[1:])}
    return Model(pieces, bytes_at, hexes, max(map(len, plain)), byte_score, scores, pairs, {p: i for p, (_, i, _) in zip(plain, pieces)})


def _lattice(words: DataFrame, model: Model) -> DataFrame:
    """(part, word, seen) to part, word, seen, edges: every piece that fits, as packed longs in order of (stop, start).

    The lowest bits are the id, or the number of ids and the bytes of a character without a piece.
    The rows stay where ``part`` put them.
    """
    # as long as the vocabulary, whatever the corpus
    pieces = F.broadcast(words.sparkSession.createDataFrame([(p, i) for p, i, _ in model.pieces], "piece string, id int"))
    numbered = words.select("part", F.monotonically_increasing_id().alias("nr"), "word", "seen", F.translate("word", " ", SPACE).alias("w"))
    at = numbered.select("part", "nr", "word", "seen", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("start"))
    cut = at.select("part", "nr", "word", "seen", "w", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("w") - F.col("start") + 1))).alias("len"))
    cut = cut.select("part", "nr", "word", "seen", "start", "len", F.substring("w", F.col("start"), F.col("len")).alias("piece"))
    fit = cut.join(pieces, "piece", "left").where(F.col("id").isNotNull() | (F.col("len") == 1))
    spare = F.octet_length(F.translate("piece", SPACE, " ")) + len(model.hexes)
    edge = (F.col("start") + F.col("len") - 1).cast("long") * (1 << _STOP) + (F.col("start") - 1).cast("long") * (1 << _START) + F.coalesce("id", spare)
    # the number comes first: rows are sorted in place by their first key
    return fit.groupBy("nr", "part", "word", "seen").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _start(edge: Column) -> Column:
    return F.shiftright(edge, _START).bitwiseAND((1 << _STOP - _START) - 1).cast("int")


def _id(edge: Column) -> Column:
    return edge.bitwiseAND((1 << _START) - 1).cast("int")


def _viterbi(edges: Column, model: Model) -> Column:
    """The last edge of the best path to each end position, from 0, where it is 0."""
    scores = F.from_json(F.lit(json.dumps(model.scores)), "array<double>")
    zero = F.struct(F.array().cast("array<double>").alias("score"), F.array().cast("array<bigint>").alias("edge"), F.lit(0.0).alias("best"), F.lit(0).cast("long").alias("by"))

    def step(a: Column, e: Column) -> Column:
        state = lambda score, edge, best, by: F.struct(score.alias("score"), edge.alias("edge"), best.alias("best"), by.alias("by"))
        way = lambda score: F.get(score, _start(e)) + F.get(scores, _id(e))
        closed = F.array_append(a["score"], a["best"])
        # edges to one end come by start: the longest first, which keeps a tie
        same = F.when(way(a["score"]) > a["best"], state(a["score"], a["edge"], way(a["score"]), e)).otherwise(a)
        return F.when(F.shiftright(e, _STOP) == F.shiftright(a["by"], _STOP), same).otherwise(state(closed, F.array_append(a["edge"], a["by"]), way(closed), e))

    return F.aggregate(edges, zero, step, lambda a: F.array_append(a["edge"], a["by"]))


def _path(best: Column) -> Column:
    """Walk back from the end: the edges in order."""
    end = F.size(best) - 1
    zero = F.struct(end.alias("at"), F.array().cast("array<bigint>").alias("path"))

    def step(a: Column, i: Column) -> Column:
        here = F.get(best, i)
        return F.when(i == a["at"], F.struct(_start(here).alias("at"), F.concat(F.array(here), a["path"]).alias("path"))).otherwise(a)

    return F.aggregate(F.sequence(end, F.lit(1), F.lit(-1)), zero, step)["path"]


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """Distinct (part, word) with ``seen`` to part, word, seen, ids."""
    paths = _lattice(words, model).select("part", "word", "seen", let(_viterbi(F.col("edges"), model), _path).alias("path"))

    def byte_ids(edge: Column) -> Column:
        raw = F.hex(F.encode(F.substring("word", _start(edge) + 1, F.lit(1)), "UTF-8"))
        spots = F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))
        return F.transform(spots, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int") + model.bytes_at)

    known = len(model.hexes)
    spelled = F.flatten(F.transform("path", lambda e: F.when(_id(e) < known, F.array(_id(e))).otherwise(byte_ids(e))))
    return paths.select("part", "word", "seen", F.when(F.exists("path", lambda e: _id(e) >= known), spelled).otherwise(F.transform("path", _id)).alias("ids"))


def long_word_ids(word: str, model: Model) -> list[int]:
    """The ids of one word by the same recurrence, in time linear in its length."""
    known = model.ids
    score, last, spare = [0.0], [(0, 0)], len(model.hexes)
    for stop in range(1, len(word) + 1):
        best = by = None
        for start in range(max(0, stop - model.longest), stop):
            i = known.get(word[start:stop])
            if i is None and start == stop - 1:
                i = spare + len(word[start].encode())
            if i is not None and (best is None or score[start] + model.scores[i] > best):
                best, by = score[start] + model.scores[i], (start, i)
        score.append(best)
        last.append(by)
    out, at = [], len(word)
    while at:
        start, i = last[at]
        out += [i] if i < spare else [model.bytes_at + b for b in reversed(word[start:at].encode())]
        at = start
    return out[::-1]


_SPLIT = re.compile(WORD)


def words_of(text: str) -> list[str]:
    """The words of a text, with the leading space that encoding adds."""
    out: list[str] = []
    for i, line in enumerate((" " + text).split("\n")):
        if i:
            out.append("\n")
        if "  " in line or line.endswith(" "):
            out += _SPLIT.findall(line)
        elif line:
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
    return out


def numbered_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of ``words_of`` in the order in which they come, a line feed first; the number of each word of the texts, text after text; the words of each text."""
    raw = [t.encode() for t in texts]
    # a space begins a text (an empty one has no words), a line feed the whole, which makes it word 0
    data = np.frombuffer(b"\n" + b"".join(b" " + t if t else t for t in raw), np.uint8)
    size = np.array([len(t) + 1 if t else 0 for t in raw], np.int64)
    del raw
    feed, space = data == 10, data == 32
    begins = feed.copy()
    begins[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    ends = 1 + np.cumsum(size)
    begins[(ends - size)[size > 0]] = True
    at = np.flatnonzero(begins).astype(np.int32)
    del feed, space, begins
    counts = np.diff(np.searchsorted(at, np.append(1, ends)))
    words = pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy()[1:].astype(np.uint32), counts


#: Marks a cut inside a word; no text has it.
_CUT = "\ud800"


class Cutter:
    """Cuts words where no piece can cross."""

    def __init__(self, pairs: set[str]) -> None:
        chars = sorted({c for p in pairs for c in p})
        self.top, at = ord(chars[-1]) + 1, {c: i + 1 for i, c in enumerate(chars)}
        self.number = np.zeros(self.top + 1, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.crossed = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.crossed[at[a], at[b]] = True

    def __call__(self, words: list[str]) -> str:
        """The words, none with a line feed, in lines, their parts divided by ``_CUT``."""
        codes = np.frombuffer("\n".join(words).encode("utf-32-le"), "<u4")
        number = self.number[np.minimum(codes, self.top)]
        feed = codes == 10
        cut = ~self.crossed[number[:-1], number[1:]] & ~feed[:-1] & ~feed[1:]
        marked = np.insert(codes, np.flatnonzero(cut) + 1, ord(_CUT))
        return marked.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _block_parts(marked: str, parts: int) -> tuple[list[str], np.ndarray]:
    """The distinct parts of up to LONG characters of marked words, by the number of their shuffle part, and these numbers."""
    found = [x for x in dict.fromkeys(marked.replace(_CUT, "\n").split("\n")) if 0 < len(x) <= LONG]
    number = np.array([zlib.crc32(w.encode()) for w in found], np.int64) * parts >> 32
    order = np.argsort(number, kind="stable")
    return [found[i] for i in order], number[order]


def _packed_rows(rows: pa.Table, codes: np.ndarray, marked: str) -> bytes:
    """The rows without their texts, which are rows of numbers of words; the numbers as planes of bytes."""
    codec, sink = pa.Codec("zstd", 4), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_table(rows.combine_chunks())
    planes, known = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), marked.encode("utf-8", "surrogatepass")
    return pickle.dumps((sink.getvalue().to_pybytes(), len(planes), codec.compress(planes, asbytes=True), len(known), codec.compress(known, asbytes=True)))


def _unpacked_rows(data: bytes) -> tuple[pa.Table, np.ndarray, bytes]:
    rows, n, planes, m, known = pickle.loads(data)
    codec = pa.Codec("zstd", 4)
    codes = np.ascontiguousarray(np.frombuffer(codec.decompress(planes, n, asbytes=True), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return pa.ipc.open_stream(rows).read_all(), codes, codec.decompress(known, m, asbytes=True)


_SENT = ["part", "block", "words", "data"]


def _send(df: DataFrame, text: str, parts: int, cutter: Cutter) -> DataFrame:
    """For each block of rows: its distinct words by part, and, under a part of its own, the rows themselves.

    Blocks end at row boundaries that depend on the rows alone, and are numbered within the scan's partition.
    """

    def run(batches):
        held, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 24

        def done():
            block, none = parts + number, np.array([t is None for t in texts], bool)
            known, codes, counts = numbered_words([t or "" for t in texts])
            texts.clear()
            marked = cutter(known[1:])  # number 0 is the line feed
            words, part = _block_parts(marked, parts)
            edges = np.searchsorted(part, np.arange(parts + 1))
            filled = [p for p in range(parts) if edges[p] < edges[p + 1]]
            for at in range(0, len(filled), 64):
                some = filled[at : at + 64]
                blobs = ["\n".join(words[edges[p] : edges[p + 1]]) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array(blobs), pa.nulls(len(some), pa.binary())], _SENT)
            rows = pa.Table.from_batches(held).append_column("ids", pa.array(counts, pa.int64(), mask=none))
            data = _packed_rows(rows, codes, marked)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.array([data], pa.binary())], _SENT)

        for batch in batches:
            at, rest = 0, batch.select([c for c in batch.schema.names if c != text])
            for i, t in enumerate(batch[text].to_pylist()):
                texts.append(t)
                size += len(t or "")
                if size > BLOCK_CHARS:
                    held.append(rest.slice(at, i + 1 - at))
                    yield from done()
                    held, size, number, at = [], 0, number + 1, i + 1
                    give_back()
            if at < batch.num_rows:
                held.append(rest.slice(at))
        if held:
            yield from done()
        held = []
        give_back()

    return small_batches(df).mapInArrow(run, "part long, block long, words string, data binary")


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _spread(known: list[bytes], codes: np.ndarray, stop: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words with the given numbers, and where, in units of ``width``, each row ends; the rows end at ``stop`` numbers.

    Arrow copies word by word: places of single bytes in numpy would take 24 bytes for each of them.
    """
    found = pa.array(known, pa.large_binary()).take(pa.array(codes))
    _, ends, letters = found.buffers()
    ends = np.frombuffer(ends, np.int64, len(found) + 1)[np.append(0, stop)]
    return np.frombuffer(letters, np.uint8, int(ends[-1])), ends // width


def _valid(none: np.ndarray):
    return pa.py_buffer(np.packbits(~none, bitorder="little")) if none.any() else None


def encode(df: DataFrame, text: str = "text", model_path: str = MODEL) -> DataFrame:
    """``df`` (a stored table) with ``ids`` (array<int>).

    One scan cuts the rows into blocks of some megabytes. One shuffle carries
    each block, compressed, and its distinct words, which go to the part of
    their checksum, meet the words of other blocks there, and send their ids
    back to the block. So a word travels once a block, not once an occurrence.
    """
    model, spark = load_model(model_path), df.sparkSession
    df = df.drop("ids")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(96, size // PART_BYTES)
    # a fixed number of partitions: a word grows to dozens of edges, which sizes measured before don't tell.
    # All three uses of ``sent`` take all its columns, so that one shuffle serves them
    cutter, packed = Cutter(model.pairs), pickle.dumps(model)  # long words are rare: a task unpacks the model only if it meets one
    sent = _send(df.select(*[c for c in df.columns if c != text], text), text, parts, cutter).repartition(parts, "part")
    words = F.explode(F.when(F.col("data").isNull(), F.split("words", "\n"))).alias("word")
    distinct = sent.select("part", "block", words).groupBy("part", "word").agg(F.min("block").alias("seen"))
    known = encode_words(distinct, model).select(F.col("part").alias("own_part"), "word", "ids", "seen")
    narrow = np.dtype("<u2" if len(model.hexes) <= 1 << 16 else "<i4")

    def only(some: Column, what: str) -> DataFrame:
        """The rows of ``sent`` with ``some``, where they are; a plain filter would slip below the shuffle, and need one of its own."""
        return sent.select("part", F.explode(F.when(some, F.array(F.struct("block", what)))).alias("s")).select("part", "s.block", f"s.{what}")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["ids"].combine_chunks()
        offsets = ids.offsets.to_numpy() if len(ids) else np.zeros(1, np.int32)
        flat, number = ids.values.to_numpy().astype(narrow) if len(ids) else np.empty(0, narrow), {w: i for i, w in enumerate(right["word"].to_pylist())}
        counts, out = [], []
        for blob in left["words"].to_pylist():
            at = np.array([number[w] for w in blob.split("\n")])
            sizes = np.diff(offsets)[at]
            counts.append(sizes.astype("<u2").tobytes())
            out.append(_gathered(flat, offsets[at], sizes).tobytes())
        give_back()
        return pa.table({"block": left["block"], "part": left["part"], "counts": pa.array(counts, pa.binary()), "ids": pa.array(out, pa.binary())})

    asked = only(F.col("data").isNull(), "words")
    answers = asked.groupBy("part").cogroup(known.groupBy("own_part")).applyInArrow(answer, "block long, part long, counts binary, ids binary")
    feed = np.array([next((i for p, i, _ in model.pieces if p == "\n"), model.bytes_at + 10)], "<i4").tobytes()
    schema = StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType()))])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        by_part = {p: (c, i) for p, c, i in zip(*(right[n].to_pylist() for n in ("own_part", "counts", "ids")))}
        out = []
        for data in left["data"].to_pylist():
            rows, codes, raw = _unpacked_rows(data)
            marked = raw.decode("utf-8", "surrogatepass")
            words, part = _block_parts(marked, parts)
            used = np.unique(part).tolist()
            sizes = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(by_part[p][0], "<u2") for p in used)]).astype(np.int64)
            if len(sizes) != len(words):
                raise ValueError("the rows of a block have changed since its words were sent")
            flat = np.concatenate([np.empty(0, narrow), *(np.frombuffer(by_part[p][1], narrow) for p in used)]).astype("<i4").tobytes()
            stops = (np.cumsum(sizes) * 4).tolist()
            piece = {w: flat[a:b] for w, a, b in zip(words, [0, *stops], stops)}
            spelled = lambda x: np.array(long_word_ids(x, pickle.loads(packed)), "<i4").tobytes()
            ids = [feed, *(piece[w] if w in piece else b"".join([piece[x] if x in piece else spelled(x) for x in w.split(_CUT) if x]) for w in marked.split("\n"))]
            n_words = rows["ids"].combine_chunks()
            none, stop = np.asarray(n_words.is_null()), np.cumsum(np.asarray(n_words.fill_null(0)))
            values, offsets = _spread(ids, codes, stop, 4)
            letters, ends = _spread([b"\n", *raw.replace(_CUT.encode("utf-8", "surrogatepass"), b"").split(b"\n")], codes, stop, 1)
            # the first word of a text begins with a space of its own
            begun = np.diff(ends) > 0
            letters, ends = np.delete(letters, ends[:-1][begun]), ends - np.append(0, np.cumsum(begun))
            held = pa.Array.from_buffers(pa.utf8(), len(none), [_valid(none), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
            found = pa.Array.from_buffers(pa.list_(pa.int32()), len(none), [_valid(none), pa.py_buffer(offsets.astype(np.int32))], children=[pa.array(values.view("<i4"))])
            columns = {c: rows[c] for c in rows.column_names if c != "ids"} | {text: held, "ids": found}
            out.append(pa.table({f.name: columns[f.name] for f in schema}))
            del piece, ids, values, letters, codes, flat, held, found
            give_back()
        return pa.concat_tables(out) if out else pa.schema([]).empty_table()

    back = answers.select(F.col("block").alias("own_block"), F.col("part").alias("own_part"), "counts", "ids")
    blocks = only(F.col("data").isNotNull() & F.col("words").isNull(), "data")
    return blocks.groupBy("part").cogroup(back.groupBy("own_block")).applyInArrow(apply, schema)


def decode(ids: Column, model_path: str = MODEL) -> Column:
    """The text of an array of ids."""
    hexes = F.from_json(F.lit(json.dumps(load_model(model_path).hexes)), "array<string>")
    whole = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")), "UTF-8")
    return F.substring(whole, 2, 2**31 - 1)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("back", decode(F.col("ids")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("back") == F.col("text")).alias("round_trip"), F.sha2(F.col("back").cast("binary"), 256).alias("decoded_sha256"))
