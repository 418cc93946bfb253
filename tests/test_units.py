"""Small cases with known results."""

import gzip
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewright.functions import curves, dna, text
from basewright.operators import catalog, controls, interactions, masking, metrics, probes, qc, sampling, tokens, windows
from basewright.sources import fasta, tabular
from basewright.streaming import jobs


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# quality control


def test_invalid_symbols_are_removed(spark):
    df = rows(spark, [("f", 0, "acgt"), ("f", 1, "ACGR")], "file string, record_idx long, seq string")
    c = qc.classify(df, 1, 100.0, 0.0)
    assert {r.record_idx: (r.trimmed, r.reason) for r in c.collect()} == {0: ("ACGT", None), 1: ("ACGR", "ambiguous")}
    s = qc.counters(c).first()
    assert (s.total_seqs, s.kept_seqs, s.removed_ambiguous) == (2, 1, 1)


def test_n_threshold_is_strict(spark):
    df = rows(spark, [("f", 0, "ACGTN"), ("f", 1, "ANNNN")], "file string, record_idx long, seq string")
    s = qc.counters(qc.classify(df, 1, 20.0, 0.0, dedupe=False)).first()
    assert (s.kept_seqs, s.removed_n) == (1, 1)


def test_hash_ignores_strand(spark):
    df = rows(spark, [("AACG",), ("CGTT",)], "seq string")
    assert df.select(dna.canonical_hash(F.col("seq"))).distinct().count() == 1


def test_qc_of_nothing(spark):
    df = rows(spark, [], "file string, record_idx long, seq string")
    assert qc.counters(qc.classify(df)).count() == 0
    assert rows(spark, [("",)], "seq string").select(dna.entropy(F.col("seq"))).first()[0] == 0.0


def test_contig_filter_and_split(spark):
    df = rows(spark, [("accepted", "acgtnnacgt"), ("plasmid sequence", "ACGTACGT"), ("x", "ACGTRACGT")], "header string, seq string").withColumn("seq", F.upper("seq"))
    ok = df.where(qc.contig_passes(F.col("header"), F.col("seq"), 4, 0.25, True) & ~qc.has_foreign(F.col("seq")))
    pieces = tokens.contig_pieces(ok, 4, "header").select("piece", "name").collect()
    assert [(p.piece, p.name) for p in pieces] == [("ACGT", "accepted_chunk_0"), ("ACGT", "accepted_chunk_1")]
    assert df.where(qc.contig_passes(F.col("header"), F.col("seq"), 4, 0.10, True)).select("header").collect()[0].header == "x"


def test_gate_uses_default_limits(spark):
    df = rows(spark, [("bacteria", 10, 4), ("virus", 10, 5), ("eukaryotes", 10, 5), ("archaea", 0, 0)], "domain string, total_seqs long, removed_total long")
    assert {r.domain: r.passed for r in qc.gate(df).collect()} == {"bacteria": True, "virus": False, "eukaryotes": True, "archaea": False}


# quotas, windows, splits


def test_quota_skips_duplicates_and_overflow(spark):
    data = [("s", 0, "AACCGG"), ("s", 1, "CCGGTT"), ("s", 2, "ACCC"), ("s", 3, "GGGG")]
    df = rows(spark, data, "species string, ord long, seq string").withColumns({"hash": dna.canonical_hash(F.col("seq")), "n": F.length("seq")})
    assert sorted(r.ord for r in windows.quota_append(df, 10).collect()) == [0, 2]


def test_split_is_disjoint_and_never_empty(spark):
    df = rows(spark, [("f", 0, 1), ("f", 1, 1)], "file string, record_idx long, wc long")
    assert {r.record_idx: r.split for r in windows.split_records(df, 0.99).collect()} == {0: "train", 1: "eval"}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 700), st.integers(1, 120), st.integers(1, 120), st.data())
def test_window_formula_equals_the_loop(spark, length, longest, stride, data):
    least = data.draw(st.integers(1, longest))
    want, s = [], 0
    if length >= least:
        if length <= longest:
            want = [0]
        else:
            while s <= length - least:
                want.append(s)
                if s + longest >= length:
                    break
                s += stride
    r = spark.range(1).select(windows.window_starts(F.lit(length), longest, stride, least).alias("s"), windows.window_count(F.lit(length), longest, stride, least).alias("n")).first()
    assert r.s == want and r.n == len(want)


def test_round_robin(spark):
    df = rows(spark, [(0, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 4)], "src int, pos int, v int")
    assert [r.v for r in sampling.round_robin(df, "src", "pos").orderBy("turn", "src").collect()] == [1, 2, 3, 4]


def test_batches_skip_once(spark):
    df = rows(spark, [(0, 64), (1, 64), (2, 64)], "id int, len int")
    assert sampling.length_batches(df, "len", "id", 1, 5, skip=1).count() == 2
    assert sampling.length_batches(df, "len", "id", 1, 5).count() == 3


def test_long_chunks(spark):
    df = rows(spark, [(7, "A" * 25)], "record_idx long, seq string")
    assert [r.name for r in tokens.long_chunks(df, 10, 6).collect()] == ["7_0_10", "7_10_20"]


# tokens


def test_base_encoding(spark):
    e = rows(spark, [("ACGT",)], "seq string").select(tokens.encode_base(F.col("seq"), 8, pad=True).alias("e")).first().e
    assert e.input_ids == [2, 5, 6, 7, 8, 3, 0, 0]
    assert list(zip(e.starts, e.ends)) == [(0, 0), (0, 1), (1, 2), (2, 3), (3, 4), (0, 0), (0, 0), (0, 0)]
    assert rows(spark, [([2, 5, 6, 7, 8, 3, 0],)], "ids array<int>").select(tokens.decode_base(F.col("ids"))).first()[0] == "ACGT"


def test_pair_merging_equals_the_library(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    counts = rows(spark, [("ACGTAC", 5), ("TTTTTT", 9)], "kmer string, n long")
    vocab = [tuple(r) for r in tokens.build_vocabulary(counts, 1400).orderBy("id").collect()]
    merges = [(a, b) for _, _, r, a, b in sorted((v for v in vocab if v[2] is not None), key=lambda v: v[2])]
    library = Tokenizer(BPE({t: i for i, t, *_ in vocab}, merges, unk_token="[UNK]"))
    rng = random.Random(3)
    seqs = ["", "A", "TTTTTTT", "GATTACA", "CAACN"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    encode = tokens.bpe_encoder(vocab, specials=False)
    got = rows(spark, [(i, s) for i, s in enumerate(seqs)], "i int, s string").select("i", encode("s").alias("e")).orderBy("i").collect()
    for r, s in zip(got, seqs):
        assert r.e.input_ids == library.encode(s).ids


def test_token_metadata():
    a = tokens.tokenizer_metadata("DNA-BPE", ["A", "C"], 3)
    tokens.check_compatible(a, a)
    with pytest.raises(ValueError):
        tokens.check_compatible(tokens.tokenizer_metadata("base", ["A", "C"], 3), a)
    with pytest.raises(ValueError):
        tokens.tokenizer_kind("words")


def test_parsers(spark):
    assert tokens.parse_indices("2,0,2", 3) == [0, 2] and tokens.parse_indices("all", 2) == [0, 1]
    with pytest.raises(ValueError):
        tokens.parse_indices("5", 3)
    assert [tuple(r) for r in tokens.schedule(spark, "10:5,0:1").collect()] == [(0, 1), (10, 5)]


@settings(max_examples=20, deadline=None)
@given(st.text("ACGTNacgt", max_size=60))
def test_strand_properties(spark, s):
    df = rows(spark, [(s,)], "s string")
    r = df.select(dna.reverse_complement(dna.reverse_complement(F.col("s"))).alias("a"), dna.canonical_hash(F.col("s")).alias("h"), dna.canonical_hash(dna.reverse_complement(F.col("s"))).alias("k")).first()
    assert r.a == s and r.h == r.k


def test_kmers_across_stretches(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(3000))
    assert rows(spark, [(s,)], "s string").select(dna.kmers(F.col("s"), 5)).first()[0] == [s[i : i + 5] for i in range(2996)]


# masking and controls


def test_span_mask_weights_and_nothing():
    assert masking.span_mask_one([5, 6, 7], [1, 1, 1], 0.0, 3, random.Random(0).random) == [False] * 3
    for seed in range(20):
        # the only start with a weight; the span walks on from there
        assert masking.span_mask_one([5, 6, 7, 5, 5, 5], [1] * 6, 0.5, 3, random.Random(seed).random, {5: 0.0, 7: 0.0}) == [False, True, True, True, False, False]
    assert masking.span_mask_one(list(range(5, 15)), [1] * 10, 1.0, 4, random.Random(3).random) == [True] * 10


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80), st.floats(0, 1), st.integers(1, 9))
def test_span_mask_counts(ids, fraction, span):
    mask = masking.span_mask_one(ids, [1] * len(ids), fraction, span, random.Random(0).random)
    valid = sum(x > 4 for x in ids)
    assert sum(mask) == (min(max(round(valid * fraction), 1), valid) if valid and fraction > 0 else 0)
    assert not any(m and x <= 4 for m, x in zip(mask, ids))


def test_span_is_contiguous():
    mask = masking.span_mask_one(list(range(5, 17)), [1] * 12, 0.25, 3, random.Random(1).random)
    assert sum(mask) == 3 and "111" in "".join("1" if m else "0" for m in mask)
    assert masking.span_mask_one([2, 5, 6, 3, 0, 7], [1, 1, 1, 1, 0, 1], 1.0, 3, random.Random(1).random) == [False, True, True, False, False, True]


def test_motif_weights(spark):
    df = rows(spark, [([5, 6],)], "ids array<int>")
    m = masking.independent_mask(F.col("ids"), 1.0, 1, F.lit(0), weights={5: 0.0, "6": 1.0})
    assert df.select(masking.labels(F.col("ids"), m)).first()[0] == [-100, 6]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", max_size=60), st.integers(0, 9))
def test_shuffle_keeps_pairs(s, seed):
    out = controls.shuffle_pairs(s, random.Random(seed))
    assert len(out) == len(s) and out[:1] == s[:1]
    assert Counter(zip(out, out[1:])) == Counter(zip(s, s[1:]))


def test_controls_are_balanced(spark):
    df = rows(spark, [("f", 0, "ACGTACGT"), ("f", 1, "GGCCAATT")], "file string, record_idx long, seq string")
    out = controls.with_controls(df, "dinucleotide", 1).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == {"real": 2, "dinucleotide": 2}
    with pytest.raises(ValueError):
        controls.with_controls(df, "none", 1)


# metrics and probes


def test_base_metrics(spark):
    df = rows(spark, [("A", "A"), ("C", "G")], "label string, pred string")
    got = {r["class"]: (r.support, r.accuracy) for r in metrics.per_class_accuracy(df, list("ACGT")).collect()}
    assert got == {"A": (1, 1.0), "C": (1, 0.0), "G": (0, None), "T": (0, None)}


def test_perplexity_overflows_to_infinity(spark):
    assert metrics.token_loss(rows(spark, [(1, 1, 1e6)], "label int, pred int, loss double")).first().ppl == float("inf")


def test_ranking_of_one_class(spark):
    r = metrics.ranking(rows(spark, [(0.1, 1), (0.2, 1)], "score double, label int")).first()
    assert r.auroc is None and r.auprc is None


def test_regression_without_variance(spark):
    r = metrics.regression(rows(spark, [(1.0, 2.0), (1.0, 3.0)], "y double, pred double")).first()
    assert r.r2 is None and r.pearson is None and r.spearman is None


def test_probes(spark):
    train = rows(spark, [([0.0], "a"), ([0.1], "a"), ([1.0], "b"), ([1.1], "b")], "features array<double>, label string")
    test = rows(spark, [([0.05], "a"), ([1.05], "b")], "features array<double>, label string")
    r = probes.classification_probe(train, test).first()
    assert r.accuracy == 1.0 and r.macro_f1 == 1.0
    with pytest.raises(ValueError):
        probes.classification_probe(train, test.withColumn("label", F.lit("c")))
    line = rows(spark, [([float(i)], float(i)) for i in range(3)], "features array<double>, y double")
    assert probes.regression_probe(line, rows(spark, [([3.0], 3.0), ([4.0], 4.0)], "features array<double>, y double")).first().r2 is not None


def test_suite_reads_its_sequences_twice_at_most(spark):
    import pandas as pd

    seen, n = spark.sparkContext.accumulator(0), 40

    @F.pandas_udf("string")
    def read(ids: pd.Series) -> pd.Series:
        seen.add(len(ids))
        return ids.map(lambda i: "ACGT" * 5 + "AC" * (i % 7) + "GN" * (i % 3))

    df = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("record_idx"), F.explode(F.array(read("id"))).alias("seq"), (F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    got = probes.handcrafted_suite(df, ["a", "b"]).collect()
    assert sorted((r.dataset, r.probe) for r in got) == [(x, y) for x in "ab" for y in ("handcrafted", "random")]
    assert n <= seen.value <= 2 * n


@pytest.mark.parametrize("k", [1, 3])
def test_kmer_shares_of_odd_sequences(spark, k):
    seqs = [None, "", "AC", "ACGT", "NNACGTN", "acgtACG", "AAAéAAA", "AAA😀CCC"]
    got = tokens.kmer_features(rows(spark, [("f", i, s) for i, s in enumerate(seqs)], "file string, record_idx long, seq string"), k).collect()
    words = [""]
    for _ in range(k):
        words = [w + b for w in words for b in "ACGT"]
    for r in got:
        s = seqs[r.record_idx] or ""
        found = Counter(s[i : i + k] for i in range(len(s) - k + 1))
        assert r.freqs == [found[w] / max(1, len(s) - k + 1) for w in words]


def test_registered_tokenizer():
    assert probes.tokenizer("base") is tokens.encode_base
    with pytest.raises(ValueError):
        probes.tokenizer("none")


# interactions, catalogue, schedules


def test_spans_and_bins(spark):
    df = rows(spark, [(0, 0, 2, 1), (1, 2, 4, 1), (2, 4, 6, 1), (3, 6, 8, 1)], "pos int, start int, stop int, attention int")
    spans = interactions.compressed_spans(df, 2, 2)
    assert sorted((r.start, r.stop) for r in spans.collect()) == [(0, 4), (4, 8)]
    w = rows(spark, [(i, j, 1.0) for i in range(2) for j in range(2)], "i int, j int, w double")
    out = interactions.project(w, interactions.bin_overlaps(spans, 8, 4)).groupBy("i").agg(F.sum("w").alias("t")).collect()
    assert len(out) == 4 and all(abs(r.t - 1) < 1e-9 for r in out)


def test_edges_are_hidden(spark):
    w = rows(spark, [(i, j, 1.0) for i in range(5) for j in range(5)], "i int, j int, w double")
    top = interactions.top_pairs(interactions.hide_edges(w, 5, 1), 3).collect()
    assert [(r.i, r.j) for r in top] == [(1, 1), (1, 2), (1, 3)]


def test_flattened_numbers(spark):
    texts = [
        '{"task": {"accuracy": 0.75, "labels": [1], "count": 4, "ok": true, "name": "5"}, "checkpoint": {"x": 1}}', "no json", None, "{}", "[1]",
        '{"a b": 1, "a  b": 2, "d": {"e": {"f": -1e3}}, "n": null}', "".join('{"k":' for _ in range(8)) + "7" + "}" * 8, "".join('{"k":' for _ in range(9)) + "7" + "}" * 9,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.m for r in df.select("i", catalog.flattened(F.col("t")).alias("m")).collect()}
    assert got == {
        0: {"benchmark/task/accuracy": 0.75, "benchmark/task/count": 4.0}, 1: {}, 2: {}, 3: {}, 4: {},
        5: {"benchmark/a_b": 1.0, "benchmark/d/e/f": -1000.0}, 6: {"benchmark" + "/k" * 8: 7.0}, 7: {},
    }


def test_modes():
    assert catalog.resolve_mode("epoch:3") == ("epoch", 3) and catalog.resolve_mode("x.pt") == ("path", "x.pt")


@pytest.mark.parametrize("data", [[("click", None), ("purchase", 2.0), ("view", 1.0)], [("view", 1.0)], [("click", 3.0), ("purchase", None), ("purchase", 4.0)], [("click", 5.0)]])
def test_comparison_of_missing_values(spark, duck, tmp_path, same_rows, data):
    from basewright.plans import registry

    registry.load()
    rows(spark, data, "event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same_rows(registry.QUERIES["j07_comparison"](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLES["j07_comparison"]).df())


def test_cosine_ends_at_its_floor(spark):
    got = [r.x for r in spark.range(101).select(curves.cosine(F.col("id"), 10, 100, 10).alias("x")).collect()]
    assert all(a >= b - 1e-12 for a, b in zip(got[10:], got[11:])) and abs(got[100] - 0.1) < 1e-12
    with pytest.raises(ValueError):
        curves.cosine(F.col("id"), 60, 100, 60)


def test_task_categories(spark):
    names = ["splice_site_prediction", "chromatin_accessibility_atac", "gene_expression_prediction", "variant_effect_pathogenicity", "other"]
    got = [r.x for r in rows(spark, [(n,) for n in names], "n string").select(text.task_category(F.col("n")).alias("x")).collect()]
    assert got == ["short_range_motif", "long_range_regulatory", "long_range_expression", "variant_effect", "custom"]


# sources


def test_fasta_modes(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text("TT\n>one x\nAC\r\nGT\n\n>empty\n>two\nTGCA\n")
    got = lambda **k: [(r.record_idx, r.header, r.seq) for r in fasta.read_fasta(spark, str(p), **k).orderBy("record_idx").collect()]
    assert got(mode="drop") == [(0, "one x", "ACGT"), (1, "empty", ""), (2, "two", "TGCA")]
    assert got(mode="prepend")[0] == (0, "one x", "TTACGT")
    assert [r[0] for r in got(mode="drop", keep_empty=False)] == [0, 2]
    with pytest.raises(Exception, match="before the first header"):
        got()


def test_fasta_gzip_and_format(spark, tmp_path):
    p = tmp_path / "b.fa.gz"
    with gzip.open(p, "wt") as f:
        f.write(">a\nAC\nGT\n>b\nTT\n")
    assert [(r.header, r.seq) for r in fasta.read_fasta(spark, str(p)).orderBy("record_idx").collect()] == [("a", "ACGT"), ("b", "TT")]
    fasta.register(spark)
    df = spark.read.format("fasta").option("path", str(p)).load()
    assert [(r.header, r.seq) for r in df.orderBy("record_idx").collect()] == [("a", "ACGT"), ("b", "TT")]
    df.write.format("fasta").option("path", str(tmp_path / "out")).mode("append").save()
    assert spark.read.format("fasta").option("path", str(tmp_path / "out" / "*.fa")).load().count() == 2


def test_tables_agree(spark, tmp_path):
    data = [("ACGTACGT", "pos", "train"), ("TGCATGCA", "neg", "train"), ("AAAACCCC", "pos", "test"), ("GGGGTTTT", "neg", "test")]
    (tmp_path / "t.csv").write_text("Sequence,label,split\n" + "".join(",".join(r) + "\n" for r in data))
    (tmp_path / "t.tsv").write_text("sequence\tlabel\tsplit\n" + "".join("\t".join(r) + "\n" for r in data))
    (tmp_path / "t.jsonl").write_text("".join(f'{{"sequence": "{a}", "label": "{b}", "split": "{c}"}}\n' for a, b, c in data))
    (tmp_path / "t.json").write_text('{"records": [' + ",".join(f'{{"sequence": "{a}", "label": "{b}", "split": "{c}"}}' for a, b, c in data) + "]}")
    for name in ("t.csv", "t.tsv", "t.jsonl", "t.json"):
        df = tabular.labelled_rows(tabular.read_rows(spark, str(tmp_path / name)), "sequence", "label", "classification", "split")
        assert sorted(map(tuple, df.collect())) == sorted(data)
    with pytest.raises(ValueError):
        tabular.read_rows(spark, "x.xml")


def test_class_folders(spark, tmp_path):
    for split, label, body in (("train", "a", ">x\nAC\nGT\n"), ("test", "b", "TT\n")):
        d = tmp_path / split / label
        d.mkdir(parents=True)
        (d / "1.txt").write_text(body)
    got = fasta.read_class_folders(spark, str(tmp_path)).select("split", "label", "seq").collect()
    assert sorted(map(tuple, got)) == [("test", "b", "TT"), ("train", "a", "ACGT")]


def test_token_store_refuses(spark, tmp_path):
    df = tokens.token_store(rows(spark, [("f", 0, "ACGT")], "file string, record_idx long, seq string"))
    path, meta = str(tmp_path / "s"), tokens.tokenizer_metadata("base", list("ACGTN"), 3)
    assert fasta.write_token_store(df, path, meta) is True
    assert fasta.write_token_store(df, path, meta) is False
    with pytest.raises(ValueError):
        fasta.write_token_store(df, path, meta | {"kmer_size": 4})
    with pytest.raises(ValueError):
        fasta.read_token_store(spark, path, meta | {"kmer_size": 4})


def test_targets(spark, tmp_path):
    p = tmp_path / "t.yaml"
    p.write_text("species:\n  - name: one\n    target_mb: 5\n  - name: two\n    tax_id: 9\n")
    got = sorted((r.name, r.tax_id, r.target_mb) for r in tabular.read_targets(spark, str(p)).collect())
    assert got == [("one", None, 5.0), ("two", "9", 100.0)]


def test_history_is_tolerant(spark, tmp_path):
    p = str(tmp_path / "h")
    tabular.append_history(rows(spark, [(2, 0.5)], "step long, loss double"), p)
    tabular.append_history(rows(spark, [(1, 0.7)], "step long, loss double"), p)
    assert [r.step for r in tabular.read_history(spark, p, "step long, loss double").collect()] == [1, 2]


def test_stream_equals_batch(spark, sf):
    live = jobs.run_available(jobs.step_buckets(jobs.stream_table(spark, sf, "events"), "event_id", 100), "complete")
    still = jobs.step_buckets(spark.read.parquet(f"{sf}/events.parquet"), "event_id", 100)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, still.collect()))


def test_running_total_over_ranges(spark):
    from basewright.operators.base import running_total

    rng = random.Random(2)
    data = [(rng.randint(0, 900), i, rng.randint(1, 9)) for i in range(3000)]
    got = {r.i: (r.own, r.shared) for r in running_total(running_total(rows(spark, data, "x int, i int, n int"), "x", {"own": "n"}, ("i",)), "x", {"shared": "n"}).collect()}
    total, want = 0, {}
    for x, i, n in sorted(data):
        total += n
        want[i] = (total, sum(m for y, _, m in data if y <= x)) if i % 50 == 0 else (total, None)
    assert all(got[i][0] == w[0] and w[1] in (None, got[i][1]) for i, w in want.items())
    assert running_total(rows(spark, [], "x int, i int, n int"), "x", {"own": "n"}).count() == 0
