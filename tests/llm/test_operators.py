"""The corpus operators against brute force, and on hard inputs."""

import base64
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basewright.llm import decontaminate, groups, html_text, lines, minhash, pieces, quality, queries, repeats, rlz, sharding, suffixes, warc
from basewright.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, junk and hard cases."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeféñß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, line = " ".join(words(60)), " ".join(words(12))
    out = []
    for i in range(n):
        if i > 4 and i % 7 == 0:
            t = out[i - 5]
        elif i > 4 and i % 7 == 1:
            w = (out[i - 3] or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = "\n".join(" ".join(words(rng.randint(1, 60))).capitalize() for _ in range(rng.randint(1, 6)))
            t += ("\n" + passage if i % 5 == 2 else "") + ("\n" + line if i % 3 == 0 else "")
        out.append(t)
    out += [None, "", " \n\t ", "one", "two words", "a b c", passage, "x " * 300, "#*$ %&| <> " * 30, line + "\n" + line, "\x00 nul\x0b vt"]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def texts():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns named like an operator's own are in the way on purpose
    df = spark.createDataFrame(texts, DOCS)
    return stored(df.withColumns({c: F.lit(1) for c in ("doc", "v", "key", "shard", "kept", "runs", "part", "block")}), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, duck, sf, same_rows):
    same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df())


# sharding


def test_sharding(docs, texts, empty):
    got = by_id(sharding.assign_shards(docs))
    for i, t, *_ in texts:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        cost = [-math.log((int(hashlib.md5(f":{i}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for s in range(25)]
        assert got[i].shard == min(range(24), key=cost.__getitem__) and got[i].grown_shard == min(range(25), key=cost.__getitem__)
    for s in {r.shard for r in got.values()}:
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))
    assert sharding.assign_shards(empty).count() == 0


def test_sharding_weights_and_repeats(spark):
    df = spark.createDataFrame([(i % 1500, "t") for i in range(3000)] + [(None, None)], "doc_id long, text string")
    rows = sharding.assign_shards(df, weights=[1.0, 3.0]).collect()
    share = sum(r.shard == 1 for r in rows) / len(rows)
    assert len(rows) == 3001 and 0.7 < share < 0.8
    assert len({(r.shard, r.slot) for r in rows}) == 3001
    with pytest.raises(ValueError):
        sharding.assign_shards(df, weights=[0.0])


# html


def test_html_tree_fits_its_table():
    tree = html_text.train_tree(html_text.LABELLED)
    assert all(html_text.classify(tree, r) == r[-1] for r in html_text.LABELLED)


def test_html_pages(spark):
    para = "A long paragraph of plain running words that goes on and on for a while, so that it is clearly text. " * 2
    pages = {
        0: ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div>"
            "<article><h1>Title &amp; more</h1><p>One<br>two &lt;3</p><p>Ti.</p><form>Mail <input></form><div id=\"comments\"><p>Nice words from a reader</p></div></article><footer>&copy; x</footer>", "Title & more\n\nOne two <3\n\nTi."),
        1: (f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><p>{para}</p><p>{para}</p></div><div class=sidebar><p>{para}</p></div><div><a href=c>Imprint</a></div>", "\n\n".join([" ".join(para.split())] * 2)),
        2: ("", ""), 3: (None, ""), 4: ("<article><p>Cut off <b", "Cut off"), 5: ("<article>no end <!-- open", "no end"), 6: ("<<>><p x='>' <article>", ""),
    }
    df = spark.createDataFrame([(k, "u", v[0], 1) for k, v in pages.items()] + [(None, None, None, 1)], "page_id long, url string, html string, text int")
    got = by_id(html_text.extract_text(df), "page_id")
    for k, (_, want) in pages.items():
        if k < 6:
            assert got[k].text == want and got[k].n_chars == len(want)
    assert len(got) == 8


def test_html_hard_pages():
    tree = html_text.train_tree(html_text.LABELLED)
    para = " ".join(f"word{i}" for i in range(40))
    last = " ".join(f"last{i}" for i in range(30))
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    both = f"{para}\n\n{last}"
    pages = {
        f"<body>{menu}<p>{para}</p><p>{last}</p><div>Imprint</div>": both,  # the last paragraph stays
        f"<body>{menu}<p>{para}</p><p>{last}</p>": both,
        f"<body><p>{para}</p>": para,
        f"<article><select><option>x<p>{para}</p><p>{last}</p></article>": f"x\n\n{both}",  # an unclosed element takes nothing along
        f"<article><button>Go<p>{para}</p></article>": f"Go\n\n{para}",
        f"<article><script>var a</script foo><p>{para}</p></article>": para,
        f"<article><script src=x />code()</script><p>{para}</p></article>": para,
        f"<article><p class=it's>{para}</p><p title='a>b' id=\"c>d\">{last}</p></article>": both,
        f"<article><section class='related-work'><p>{para}</p></section><div class='post-share-price'><p>{last}</p></div></article>": both,
        f"<div class='content-widget'><article><p>{para}</p></article></div>": para,
        f"<article><p>{para}</p><div class='comment-list'><p>{last}</p></div><aside>{last}</aside></article>": para,
    }
    for page, want in pages.items():
        assert html_text.main_text(page, tree) == want, page
    used, todo = set(), [tree]
    while todo:
        node = todo.pop()
        if len(node) > 1:
            used.add(html_text.FEATURES[node[0]])
            todo += node[2:]
    assert used & {"words_before", "links_before"} and used & {"words_after", "links_after"}


# near duplicates


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def reachable(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, empty, width, percent):
    sets = [shingles(t, width) for _, t, *_ in texts]
    link = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = reachable(len(sets), link)
    got = by_id(minhash.near_duplicates(docs, width=width, percent=percent))
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in got} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [shingles(t, 3) for t in texts]
    want = reachable(150, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].component_id for i in range(150)] == want


def test_estimate_is_close(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = minhash._functions()
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    df = spark.createDataFrame([tuple(minhash.bit_planes(minhash.minima(v, a, b)).tolist() for v in (x, y))], "p array<long>, q array<long>")
    assert abs(df.select(minhash.estimate(F.col("p"), F.col("q"))).first()[0] - 900 / 1100) < 0.2


def test_null_ids_stay_apart(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (3, 1, False), (3, 1, False)]


def test_components_of_shapes(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.id: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[202] == 200 and 300 not in got


@pytest.mark.parametrize("few", [0, 3, 100_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(groups, "FEW_EDGES", few)
    rng = random.Random(few)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)]
    want = reachable(600, lambda a, b, known={*edges, *((b, a) for a, b in edges)}: (a, b) in known)
    got = {r.id: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


# substrings


def test_repeated_words(docs, texts, empty):
    where = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - 34):
            where.setdefault(tuple(w[p : p + 35]), []).append((i, p))
    gone = [set() for _ in split]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + 35))
    got = by_id(rlz.remove_repeats(docs))
    for i, w in enumerate(split):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone[i]), " ".join(x for p, x in enumerate(w) if p not in gone[i]))
        assert sum(s.stop - s.start for s in got[i].spans) == len(gone[i])
    assert rlz.remove_repeats(empty).count() == 0


def test_repeated_bytes(docs, texts, empty):
    raw = [(t or "").encode() for _, t, *_ in texts]
    first = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    got = by_id(suffixes.remove_repeats(docs))
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(gone), spans, kept)
    assert suffixes.remove_repeats(empty).count() == 0


def test_crowded_anchors_are_merged(docs, monkeypatch):
    want = {k: bytes(r.kept) for k, r in by_id(suffixes.remove_repeats(docs)).items()}, {k: r.kept for k, r in by_id(rlz.remove_repeats(docs)).items()}
    monkeypatch.setattr(repeats, "CROWD", 1)
    got = {k: bytes(r.kept) for k, r in by_id(suffixes.remove_repeats(docs)).items()}, {k: r.kept for k, r in by_id(rlz.remove_repeats(docs)).items()}
    assert got == want


def test_factors_travel_in_one_row_a_shard(spark):
    import numpy as np

    rng, one = random.Random(4), [np.array([[0, 1]], np.int32).tobytes()]
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(1_200)]
    df = spark.createDataFrame([(i, t, one if i % 3 else [], [] if i % 3 else one) for i, t in enumerate(texts)], "doc long, text string, runs array<binary>, crowd array<binary>").coalesce(1)
    content = lambda raw, r, run: raw[r.first[run] : r.first[run] + r.count[run] - 1 + 50]
    got = repeats.ask_content(df, suffixes.byte_symbols, 20, 50, 6, 4, content).collect()
    assert sorted(r.shard for r in got) == [*range(-4, 0), *range(6)]
    seen = {}
    for r in got:
        at = 0
        for doc, first, count in zip(np.frombuffer(r.docs, "<i8").tolist(), np.frombuffer(r.firsts, "<i4").tolist(), np.frombuffer(r.counts, "<i4").tolist()):
            seen[doc] = (r.shard < 0, bytes(r.content[at : at + count + 49]) == texts[doc].encode()[first : first + count + 49])
            at += count + 49
        assert at == len(r.content)
    assert seen == {i: (i % 3 == 0, True) for i in range(1_200)}


def test_suffix_array_of_random_strings():
    import numpy as np

    rng = random.Random(2)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        text = np.array([c + 1 if c else 0 for c in b"".join(p + b"\0" for p in parts)], np.int64)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        sa, rank = suffixes.suffix_array(text, int(sizes.max()) + 1)
        ends = np.flatnonzero(text == 0)
        key = lambda i: [(int(x), -1) if x else (0, int(np.searchsorted(ends, i))) for x in text[i : ends[np.searchsorted(ends, i)] + 1]]
        assert sorted(range(len(text)), key=key) == sa.tolist() and (sa[rank] == np.arange(len(text))).all()
        lcp = suffixes.common_prefixes(text, sa, rank, starts, sizes)
        for r in range(1, len(sa)):
            a, b = key(sa[r - 1])[:-1], key(sa[r])[:-1]
            assert lcp[sa[r]] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# sentence pieces


def best_score(word, model):
    table = {p: s for p, _, s in model.pieces}
    word = word.replace(" ", pieces.SPACE)
    best = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - model.longest), j):
            s = table.get(word[i:j])
            if s is None and j == i + 1:
                s = len(word[i:j].replace(pieces.SPACE, " ").encode()) * model.byte_score
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_pieces_round_trip_and_best_path(docs, texts, empty):
    model = pieces.load_model()
    score = {i: s for _, i, s in model.pieces}
    got = by_id(pieces.encode(docs.select("doc_id", "text")).withColumn("back", pieces.decode(F.col("ids"))))
    for i, t, *_ in texts:
        assert got[i].back == t and (got[i].ids is None) == (t is None)
        if t:
            want = sum(best_score(w, model) for w in pieces.words_of(t))
            assert sum(score.get(x, model.byte_score) for x in got[i].ids) == want
    assert pieces.encode(empty).count() == 0


def test_pieces_of_odd_texts(spark):
    odd = ["  lead", "trail  ", "tab\there", "emoji 😀 and 漢字", "\n\n", "▁marked", "x" * 5000]
    df = stored(spark.createDataFrame(list(enumerate(odd)), "i int, text string"), "odd")
    back = {r.i: r.back for r in pieces.encode(df).select("i", pieces.decode(F.col("ids")).alias("back")).collect()}
    assert [back[i] for i in range(len(odd))] == [t.replace(pieces.SPACE, " ") if pieces.SPACE in t else t for t in odd]


def test_pieces_over_many_blocks(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(pieces, "LONG", 7)
    one = pieces.encode(docs.withColumn("ids", F.lit("replaced")))
    got = {r.doc_id: r for r in one.select("doc_id", "lang", "ids").collect()}
    monkeypatch.undo()
    want = {r.doc_id: r for r in pieces.encode(docs).select("doc_id", "lang", "ids").collect()}
    assert len(got) == len(texts) and got == want


def test_words_of_a_block_are_numbered_without_python_words():
    rng = random.Random(5)
    for _ in range(300):
        made = ["".join(rng.choice([" ", "  ", "\n", "a", "é"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        known, numbers, counts = pieces.numbered_words(made)
        want = [pieces.words_of(t) if t else [] for t in made]
        assert known[0] == "\n" and [known[i] for i in numbers] == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]


def test_words_are_spread_without_a_number_for_each_byte():
    rng = np.random.default_rng(5)
    known, codes = [b"\n", b"", *(b"%08d" % i for i in range(1000))], rng.integers(0, 1002, 300_000).astype(np.uint32)
    stop = np.array([0, 7, 7, 150_000, 300_000])
    tracemalloc.start()
    letters, ends = pieces._spread(known, codes, stop, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert letters.tobytes() == b"".join(known[i] for i in codes)
    assert ends.tolist() == [0, *(len(b"".join(known[i] for i in codes[:n])) for n in stop)]
    assert peak < 4 * len(letters)  # 24 bytes for each one before
    ids, ends = pieces._spread(known, codes[:9], np.array([9]), 4)
    assert ids.tobytes() == b"".join(known[i] for i in codes[:9]) and ends.tolist() == [0, len(ids) // 4]
    for none in ([], [0, 0]):
        letters, ends = pieces._spread([b"\n"], np.empty(0, np.uint32), np.array(none, np.int64), 1)
        assert not len(letters) and ends.tolist() == [0, *none]


def test_words_meet_without_the_rows_of_their_blocks(spark, docs):
    """The rows travel under the blocks' own numbers; Python gets none of them where words get their ids."""
    plan = pieces.encode(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "answer(part" in plan and not re.search(r"answer\([^)]*\bdata#", plan)
    assert not re.search(r"apply\([^)]*\bwords#", plan)


def test_pieces_of_one_long_word(spark):
    rng = random.Random(5)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000))
    runs = "a" * 100_000 + " " * 100_000
    df = stored(spark.createDataFrame([(0, blob), (1, runs)], "i int, text string"), "long-words")
    back = {r.i: r.back for r in pieces.encode(df).select("i", pieces.decode(F.col("ids")).alias("back")).collect()}
    assert back == {0: blob, 1: runs}
    model = pieces.load_model()
    for word in (" " + blob[:300], " " + "a" * 40, "é漢" * 20):
        score = {i: s for _, i, s in model.pieces}
        assert sum(score.get(x, model.byte_score) for x in pieces.long_word_ids(word, model)) == best_score(word, model)


# lines


def test_line_dedup_keeps_first_of_equal_lines(docs, texts, empty):
    got = by_id(lines.dedup_lines(docs))
    assert got[60].text is None and got[61].text == ""
    seen, exact = set(), 0
    for i, t, *_ in texts:
        if t is None:
            continue
        left = (got[i].text or "").split("\n")
        for x in left:
            w = x.encode().lower().split()
            if len(w) >= lines.MIN_WORDS:
                assert tuple(w) not in seen  # of equal lines one stays, wherever it stands
                seen.add(tuple(w))
        exact += got[i].n_removed
        assert got[i].n_lines == len(t.split("\n")) and len(t.split("\n")) - got[i].n_removed == (len(left) if got[i].n_removed < got[i].n_lines else 0)
    every = {tuple(x.encode().lower().split()) for _, t, *_ in texts if t for x in t.split("\n")}
    fuzzy = {x for x in every if len(x) >= lines.MIN_WORDS} - seen
    assert exact > 20 and len(fuzzy) < len(every) / 3
    assert lines.dedup_lines(empty).count() == 0


def test_fuzzy_lines_are_grouped(spark):
    rng = random.Random(9)
    base = [f"word{rng.randrange(9999)}" for _ in range(200)]
    other = list(base)
    other[100] = "else"
    df = spark.createDataFrame([(2, " ".join(other)), (1, "short one\n" + " ".join(base).upper()), (3, "short one"), (None, " ".join(base))], "doc_id long, text string")
    rows = lines.dedup_lines(df).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].n_removed == 0 and got[2].n_removed == 1 and got[2].text == "" and got[3].n_removed == 0 and got[None].n_removed == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy_lines(rng, often):
    """Lines of 5 to 60 words and changed copies of them at and around similarity 0.8."""
    word = lambda: rng.choice(often) if rng.random() < 0.5 else f"w{rng.randrange(5000)}"
    out = []
    for n in [5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30, 40, 50, 60] * 6:
        base = [word() for _ in range(n)]
        out.append(base)
        for k in (n // 5, n // 5, n // 5 + 1):
            copy = list(base)
            for _ in range(k):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice(([word()], [word()], [], [copy[at], word()]))
            out.append(copy)
    rng.shuffle(out)
    return [x for x in out if len(x) >= lines.MIN_WORDS]


@pytest.mark.parametrize("pairs, alike", [(lines.ALL_PAIRS, lines.ALIKE), (3, lines.ALIKE), (3, 2), (3, 0)])
def test_fuzzy_lines_match_brute_force(spark, monkeypatch, pairs, alike):
    monkeypatch.setattr(lines, "ALL_PAIRS", pairs)  # 3: most buckets are large
    monkeypatch.setattr(lines, "ALIKE", alike)  # 2: all of them are split to the end, 0: all link to hubs
    made = fuzzy_lines(random.Random(5), [f"c{i}" for i in range(30)])
    root = list(range(len(made)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i, j in itertools.combinations(range(len(made)), 2):
        longer, shorter = max(len(made[i]), len(made[j])), min(len(made[i]), len(made[j]))
        if 5 * shorter >= 4 * longer and 5 * edits(made[i], made[j]) <= longer:
            root[max(find(i), find(j))] = min(find(i), find(j))
            linked += 1
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id for r in lines.dedup_lines(df).where("n_removed = 1").collect()}
    assert linked > 150 and got == {i for i in range(len(made)) if find(i) != i}


@pytest.mark.parametrize("n, changed, least", [(5, 1, 0.999), (10, 2, 0.999), (30, 6, 0.999), (60, 12, 0.99), (100, 20, 0.99), (100, 10, 0.998)])
def test_recall_of_candidates(n, changed, least):
    """Pairs with ``changed`` of ``n`` words replaced by new ones: how many share a bucket and pass both bounds on bits."""
    import numpy as np

    rng, pairs = random.Random(n), 1500
    made = []
    for _ in range(pairs):
        line = [b"w%d" % rng.randrange(3000) for _ in range(n)]
        other = list(line)
        for i in rng.sample(range(n), changed):
            other[i] = b"new%d" % rng.randrange(10**9)
        made += [line, other]
    flat, sizes = lines.word_digests(made)
    flat = lines.line_features(flat, sizes)
    bits = np.unpackbits(lines.simhashes(flat, sizes).view(np.uint8), axis=1).astype(int)
    keys, many = lines.word_blocks(flat, sizes, np.zeros(1 << lines.SLOT_BITS, np.uint8), 1)
    own = [set(k.tolist()) for k in np.split(keys, np.cumsum(many)[:-1])]
    apart = np.abs(bits[::2] - bits[1::2])
    near = (apart[:, :64].sum(axis=1) <= lines.BITS_APART) & (apart.sum(axis=1) <= lines.WIDE_APART)
    met = np.array([bool(a & b) for a, b in zip(own[::2], own[1::2])])
    assert (near & met).mean() >= least


def test_words_of_all_lines_are_counted(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("doc"), F.concat(F.lit("a b c d w"), F.col("id")).alias("text"))
    levels, counted = lines.word_counts(df)
    assert counted == n and levels.max() == round(8 * math.log2(1 + n))


def test_crowds_give_no_row_for_each_pair(spark):
    rng = random.Random(3)
    base, n = [f"w{i}" for i in range(40)], 120
    made = []
    for i in range(n):
        line = list(base)
        line[rng.randrange(40)] = f"x{i}"
        made.append((i, " ".join(line)))
    rows = stored(spark.createDataFrame(made, "doc long, text string"), "crowd")
    all_lines = stored(lines.hashed_lines(rows), "crowd-lines")
    found = lines.shared_buckets(all_lines.select("key", "n", "sim", "words"), 4).toPandas()
    assert found.b.notna().sum() < n < n * (n - 1) / 2 / 10
    removed = lines.dedup_lines(rows, "doc").where("n_removed = 1").count()
    assert removed == n - 1


def test_unrelated_lines_of_a_bucket_give_few_rows(spark):
    """Of 64 bits unrelated lines share enough one time in four or more, so buckets gave rows for most of their pairs."""
    rng, n = random.Random(7), 3000
    made = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(n)]
    rows = stored(spark.createDataFrame(made, "doc long, text string"), "unrelated")
    found = lines.shared_buckets(stored(lines.hashed_lines(rows), "unrelated-lines"), 4)
    assert found.where("b is not null").count() < 10 * n  # 84,901 by 64 bits, 21,744 by 128


def test_lines_near_but_not_similar_give_few_rows(spark, monkeypatch):
    """The last join of a large bucket gave a row for every pair within the bounds on bits."""
    rng, n, made = random.Random(11), 1000, []
    for i in range(n):
        line = [f"w{k}" for k in range(40)]
        for k in rng.sample(range(40), 9):
            line[k] = f"y{rng.randrange(30)}"
        made.append((i, " ".join(line)))
    rows = stored(spark.createDataFrame(made, "doc long, text string"), "near")
    seen = []

    def counted(df, label):
        out = stored(df, label)
        seen.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(groups, "stored", counted)
    got = {r.id: r.root for r in lines.line_groups(rows, stored(lines.hashed_lines(rows), "near-lines")).collect()}
    assert len(seen) == 3 and seen[-1] < 10 * n
    assert all(got[r] == r for r in got.values())


def test_texts_are_searched_where_they_are(spark):
    made = [(i, "\n".join(f"a b c d e{i} f{k}" for k in range(i % 7))) for i in range(400)]
    rows = stored(spark.createDataFrame([*made, (400, None), (401, "")], "doc long, text string"), "searched")
    wanted = [(i, k) for i in range(0, 400, 5) for k in range(i % 7) if k % 2]
    bits = lines.place_bits(stored(spark.createDataFrame(wanted, "doc long, line int"), "wanted-places"))
    coded = lines.coded_lines(rows, bits)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    got, keys = coded.toPandas().v.tolist(), [lines.line_key(f"a b c d e{i} f{k}".encode().split()) for i, k in wanted]
    assert set(keys) <= set(got) and len(got) < 1.2 * len(keys)
    assert coded.where(F.length("code") != 6).count() == 0
    assert not lines.place_bits(stored(spark.createDataFrame([], "doc long, line int"), "no-places")).any()


def test_digests_and_simhashes_of_all_lines_at_once():
    rng = random.Random(13)
    made = [[bytes(rng.randrange(97, 101) for _ in range(rng.randrange(1, 28))) for _ in range(n)] for n in (1, 5, 40, 255, 256, 700)]
    made += [[], [b"a", b"a\0", b"\0", b"a" * 8, b"a" * 8 + b"\0", b"a" * 9, b"a" * 16, b"a" * 17]]
    flat, sizes = lines.word_digests(made)
    words = [w for x in made for w in x]
    assert sizes.tolist() == [len(x) for x in made] and len(flat) == len(words)
    assert len(set(zip(words, flat.tolist()))) == len(set(words)) == len(set(flat.tolist()))
    assert [lines.word_digests([[w]])[0][0] for w in words[:50]] == flat[:50].tolist()
    full = np.flatnonzero(sizes > 0)
    got = np.unpackbits(lines.simhashes(flat, sizes[full]).view(np.uint8), axis=1, bitorder="little")
    for sim, own in zip(got, np.split(flat, np.cumsum(sizes[full])[:-1])):
        planes = [own]
        for _ in range(3):
            planes.append(lines._mixed(planes[-1] * lines._MIX[0]))
        bits = np.unpackbits(np.stack(planes, axis=1).view(np.uint8), axis=1, bitorder="little").reshape(len(own), 256)
        assert (sim == (2 * bits.sum(axis=0) > len(own))).all()


def test_short_lines_go_if_equal(spark):
    data = [(1, "les.\n\nA b\nles."), (2, "a  B\nother\n"), (3, "les. x\n\nLES."), (4, "one two three four"), (5, "one two three four\none two three five")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df, short=True).collect()}
    assert got == {1: ("les.\n\nA b", 1), 2: ("other\n", 1), 3: ("les. x\n", 1), 4: ("one two three four", 0), 5: ("one two three five", 1)}


# decontamination


def test_contamination_matches_brute_force(spark, docs, texts, empty):
    rng = random.Random(4)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(0, "one"), (1, None), (2, "..."), (3, "two words"), (10, "never seen anywhere at all by any of these documents here")]
    for k in range(6):
        w = words(rng.choice([t for _, t, *_ in texts if t and len(t) > 300]))
        at = rng.randrange(max(1, len(w) - 14))
        items.append((20 + k, " ".join(w[at : at + rng.choice([4, 10, 14])])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    for i, t, *_ in texts:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            b = words(it)
            for s in range(max(1, len(b) - 9)) if b else ():
                win = b[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma z rare")], "doc_id long, text string")
    w = decontaminate.item_windows(spark.createDataFrame([(7, "rare gamma beta alpha")], "item_id long, text string"))
    keyed = decontaminate.rarest_terms(w, decontaminate.term_counts(d, w.select(F.explode("terms").alias("term")).distinct()))
    index = decontaminate.build_index(d, keyed.select("term").distinct())
    assert decontaminate.phrase_matches(index, keyed).count() == 0
    assert [r["items"] for r in decontaminate.proximity_matches(index, keyed).collect()] == [["7"]]


# archives


def pages(spark):
    data = [(1, "http://a/ b\n", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (5, "u", ""), (4, "v", "WARC/1.1\r\nin the payload\r\n\r\n"), (6, "w", "<p>é</p>"), (None, "x", "<p>é</p>")]
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit(1))


def test_archives_round_trip(spark, tmp_path):
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_archives(warc.plan_records(pages(spark)), path, compression)
        got = by_id(warc.read_archives(spark, path), "page_id")
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 6: ("response", None), 3: ("revisit", 5), 5: ("response", None), 4: ("response", None), None: ("revisit", 6)}
        digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
        assert got[1].payload_digest == digest and got[1].payload_bytes == 9 and bytes(got[6].payload) == "<p>é</p>".encode()
        assert warc.read_gaps(spark, path).count() == 0
    warc.write_archives(warc.plan_records(pages(spark).limit(0)), str(tmp_path / "none_at_all"))
    assert warc.read_archives(spark, str(tmp_path / "none_at_all")).count() == 0


def test_salvage_of_damaged_archives(spark):
    texts = [r.t + "\r\n\r\n" for r in warc.plan_records(pages(spark), dedup_bytes=10**9).select(warc.record_text().alias("t")).collect()]
    raw = [t.encode() for t in texts]
    whole = b"".join(raw)
    assert [k for k, _ in warc.salvage(whole)] == ["record"] * 7
    broken = raw[0] + raw[1][:-30] + b"JUNK" + b"".join(raw[2:])
    kinds = list(warc.salvage(broken))
    assert sum(k == "record" for k, _ in kinds) == 6
    assert [x for k, x in kinds if k == "gap"] == [(len(raw[0]), len(raw[0]) + len(raw[1]) - 26)]
    cut = whole[: len(whole) - 3]
    assert sum(k == "record" for k, _ in warc.salvage(cut)) == 6
    packed = bytearray(warc.pack_members(raw))
    assert sum(k == "record" for k, _ in warc.salvage(bytes(packed))) == 7
    third = len(warc.pack_members(raw[:2])) + 25
    packed[third] ^= 0xFF
    kinds = list(warc.salvage(bytes(packed)))
    assert sum(k == "record" for k, _ in kinds) == 6 and sum(k == "gap" for k, _ in kinds) == 1
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"noise")) == [("gap", (0, 5))]


def test_gaps_are_logged_beside_the_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 60)  # two of the largest payload a file
    warc.write_archives(warc.plan_records(pages(spark).coalesce(1), dedup_bytes=10**9), str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 2
    data = files[0].read_bytes()
    files[0].write_bytes(data[:5] + b"#" + data[6:])
    (files[0].parent / f".{files[0].name}.crc").unlink()
    log = warc.read_logged(spark, str(tmp_path / "a"))
    (gap,) = warc.gaps_of(log).collect()
    assert gap.path.endswith(files[0].name) and gap.gap_start == 0 and warc.records_of(log).count() == 6
    heads = spark.read.option("lineSep", "\r\n\r\n").text(str(tmp_path / "a")).where("value like 'WARC/%WARC-Type%'")
    assert heads.where("value like '%WARC-Record-ID: <urn:%'").count() == heads.count()


def test_salvage_after_damaged_first_bytes():
    body = b"<p>x</p>"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    raw = [(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n" for i in range(5)]
    ids = lambda data: [x["page_id"] for k, x in warc.salvage(data) if k == "record"]
    gaps = lambda data: [x for k, x in warc.salvage(data) if k == "gap"]
    first = len(warc.pack_members(raw[:1]))
    for at in (0, 1, 2, 3, 12):
        packed = bytearray(warc.pack_members(raw))
        packed[at] ^= 0xFF
        assert ids(bytes(packed)) == [1, 2, 3, 4] and gaps(bytes(packed)) == [(0, first)]
    plain = bytearray(b"".join(raw))
    plain[:3] = b"\x1f\x8b\x08"  # a plain archive that begins like a member
    assert ids(bytes(plain)) == [1, 2, 3, 4] and gaps(bytes(plain)) == [(0, len(raw[0]))]
    mixed = b"".join(raw[:2]) + b"junk" + warc.pack_members(raw[2:])
    assert ids(mixed) == [0, 1, 2, 3, 4] and gaps(mixed) == [(len(b"".join(raw[:2])), len(b"".join(raw[:2])) + 4)]


# quality


def test_statistics(docs, texts, empty):
    got = by_id(quality.quality_verdicts(docs))
    for i, t, *_ in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[p : p + 3]) for p in range(len(w) - 2)]
        rep = {q for p, g in enumerate(grams) if grams.count(g) > 1 for q in range(p, p + 3)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(rep), failed)
        assert not (failed and r.kept)
    assert quality.quality_verdicts(empty).count() == 0


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(7)
    text = lambda junk: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + ("###" if junk else "") for _ in range(rng.randint(60, 300)))
    data = [(i, text(i % 20 == 0), "en", "s" if i % 3 else "t") for i in range(700)]
    rows = quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 20 != 0) for r in rows)


def test_verdicts_match_numpy(spark, sf):
    """The whole estimate again, one group at a time, with numpy's covariance, inverse and determinant."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 4 == 3, F.col("lang")).otherwise("xx")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    least, floor, mixed = 20, np.array(quality.SPREAD), quality.JOINT
    rows = quality.quality_verdicts(docs, min_group=least).join(docs.select("doc_id", "lang", "source", F.size(F.filter(F.split("text", "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))).alias("n_lines")), "doc_id").collect()
    good = [r for r in rows if not r.base_failed]
    count = lambda of: {k: sum(of(r) == k for r in good) for k in {of(r) for r in good}}
    own = {k for k, n in count(lambda r: (r.lang, r.source)).items() if n >= least}
    by_lang = {r.lang: sum((q.lang, q.source) not in own and q.lang == r.lang for q in good) for r in good}
    group = lambda r: (r.lang, r.source) if (r.lang, r.source) in own else r.lang if by_lang[r.lang] >= least else "*"
    assert len(own) >= 2 and len({group(r) for r in good}) > len(own)

    def vector(r):
        share = lambda a, b: math.sqrt(a / max(b, 1))
        raw = [math.log1p(r.n_words), math.log(max(r.word_chars, 1) / max(r.n_words, 1)), share(r.n_symbols, r.word_chars), share(r.n_dup_lines, r.n_lines), share(r.n_repeat_words, r.n_words)]
        return [math.floor(v * quality.SCALE + 0.5) / quality.SCALE for v in raw]

    quantile = lambda v, q: sorted(v)[math.ceil(q * len(v)) - 1]
    level = lambda d: np.floor(np.log1p(d) * 200 + 0.5)
    measure = lambda x, m: np.einsum("ni,ij,nj->n", x - m[0], np.linalg.inv(m[1]), x - m[0])

    def estimate(x):
        c = np.atleast_2d(np.cov(x.T, bias=True))
        c = mixed * c + np.diag(np.maximum(np.diag(c), floor**2) - mixed * np.diag(c))
        return x.mean(axis=0), c

    def concentrate(x, m):
        lv = level(measure(x, m))
        return estimate(x[lv <= quantile(lv, quality.CORE)])

    for g in {group(r) for r in good}:
        mine = [r for r in good if group(r) == g]
        x = np.array([vector(r) for r in mine])
        mid = np.array([quantile(c, 0.5) for c in x.T])
        mad = np.array([quantile(c, 0.5) for c in np.abs(x - mid).T])
        models = [(mid, np.diag(np.maximum(1.4826 * mad, floor) ** 2)), (mid, np.diag(floor**2)), estimate(x)]
        for _ in range(quality.FIRST_STEPS):
            models = [concentrate(x, m) for m in models]
        best = min(models, key=lambda m: round(np.linalg.det(m[1]), 18))
        for _ in range(quality.MORE_STEPS):
            step = concentrate(x, best)
            if np.linalg.det(step[1]) >= np.linalg.det(best[1]) * (1 - 1e-9):
                break
            best = step
        far = measure(x, best)
        far /= max(math.expm1(quantile(level(far), 0.5) / 200) / quality.CHI2_MEDIAN[5], 1.0)
        for r, d in zip(mine, far):
            assert abs(r.distance - d) <= 1e-6 * max(1, d) and r.kept == (d <= quality.CUTOFF)


def test_repetition_alone_is_rejected(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    data = [(i, "\n".join(line(10) for _ in range(rng.randint(6, 30)))) for i in range(400)]
    same = line(2)  # lines of two words repeat no window of three words
    data.append((1000, "\n".join(x for _ in range(20) for x in (line(10), same))))
    passage = line(40)
    data.append((1001, "\n".join([passage, passage + " end", *[line(10) for _ in range(11)]])))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in data], "doc_id long, text string, lang string, source string")
    rows = quality.quality_verdicts(df).collect()
    got = {r.doc_id: r for r in rows}
    assert not got[1000].base_failed and got[1000].n_repeat_words == 0 and got[1000].n_dup_lines == 19
    assert not got[1001].base_failed and got[1001].n_dup_lines == 0 and got[1001].n_repeat_words == 80
    assert {r.doc_id for r in rows if not r.kept} == {1000, 1001}


# pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, sf), name)
        if k < 4:
            assert docs.columns == names and docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.count() > 50 and docs.where("not round_trip").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_rows_without_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")))
    nulls = odd.where("doc_id is null").count()
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        assert nulls and stage(spark, odd, sf).where("doc_id is null").count() == nulls


def test_pipeline_of_nothing(spark, sf, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert docs.count() == 0
