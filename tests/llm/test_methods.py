"""Each method against brute force, a round trip or held-out accuracy."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberscope.llm import ann, components, decontaminate, eliasfano, fm_index, lm_score, mixing, near_dedup, substring_dedup, token_output, url_filter
from emberscope.llm.common import lower_text, word_hashes
from emberscope.llm.queries import tokenizer_path
from emberscope.session import Scratch

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SMALL)


# --- 1 -----------------------------------------------------------------------


def test_lm_base_and_gain(spark, documents):
    counts, tokens = collections.Counter(), {}
    for d, r in documents.items():
        tokens[d] = WORD.findall(lower_text(r.text)) + ["\n"]
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    got = run(spark, "op1_lm_scoring").collect()
    for r in got:
        own = tokens[r.doc_id]
        assert r.n_tokens == len(own) and r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_normalised():
    flat = lm_score.Model.start(np.full(lm_score.OUTCOMES, 1 / lm_score.OUTCOMES))
    model = lm_score.Model(flat)
    context = [3, 200, 0, 17, 5][: lm_score.CONTEXT]
    total = sum(10 ** model.log10_probabilities(np.array([*context, w]))[0] for w in range(lm_score.OUTCOMES))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_rare_words_are_joined(spark):
    df = spark.createDataFrame([(i, f"a b c{i} a d{i % 3}") for i in range(30)], "doc_id long, text string")
    learns = F.col("doc_id") < 20
    few = {r.doc_id: r for r in lm_score.score_texts(df, learns, rounds=1, frequent=2).collect()}
    # the same counts whichever words are broadcast
    many = {r.doc_id: r for r in lm_score.score_texts(df, learns, rounds=1).collect()}
    assert all(few[i].n_known == many[i].n_known and few[i].base_score == pytest.approx(many[i].base_score) for i in few)


def test_lm_context_tells_common_words_apart(spark):
    # 260 words of one ending and one count, each even one always before the next odd one
    words, rng = [f"w{i:03d}xx" for i in range(260)], random.Random(4)
    texts = [" ".join(f"{words[i]} {words[i + 1]}" for i in rng.sample(range(0, 260, 2), 130)) for _ in range(200)]
    pairs = [(i, f"{words[i]} {words[i + 1]}", f"{words[i]} {words[(i + 3) % 260]}") for i in range(200, 260, 2)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, a) for i, a, _ in pairs] + [(2000 + i, b) for i, _, b in pairs]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in lm_score.score_texts(df, F.col("doc_id") < 1000, rounds=7).collect()}
    better = [got[1000 + i] - got[2000 + i] for i, _, _ in pairs]
    assert sum(b > 0.05 for b in better) > 0.9 * len(better)


# --- 2 -----------------------------------------------------------------------


def test_nearest_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    units = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    got = collections.defaultdict(list)
    for r in run(spark, "op2_nearest_neighbours").orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    found = 0
    for q, hits in got.items():
        score = units @ (rows[q] / np.linalg.norm(rows[q]))
        score[ids == q] = -2
        found += len({h.vec_id for h in hits} & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
        assert [h["rank"] for h in hits] == [1, 2, 3, 4, 5]
        assert all(h.score == pytest.approx(score[ids == h.vec_id][0], abs=1e-12) for h in hits)
    assert found >= 0.9 * 5 * len(got)


def test_nearest_over_shards_and_common_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(i, rng.normal(size=4).tolist()) for i in range(300, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id IN (0, 299, 500)"), 5, shard_rows=100)
    near = {q: [r.vec_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 299, 500)}
    assert near[0] == [1, 2, 3, 4, 5] and near[299] == [0, 1, 2, 3, 4] and len(near[500]) == 5


def test_forest_descends_and_ascends():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(500, 8))
    forest = ann.Forest(np.arange(500), vectors, trees=4)
    hashes = ann.strings(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), forest.planes)
    assert (np.diff(forest.sorted.astype(np.int64), axis=1) >= 0).all()
    last = np.zeros((4, 500))
    for level in range(ann.LEVELS, -1, -1):
        lo, hi = forest.spans(hashes, level)
        assert ((hi - lo) >= last).all()
        last = hi - lo
    assert (last == 500).all()


# --- 3 -----------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(1, 1 << 40))
def test_elias_fano_round_trip(steps, scale):
    values = np.cumsum(np.array([0, *steps], dtype=np.uint64) * np.uint64(scale))
    coded = eliasfano.encode(values)
    ef = eliasfano.EliasFano(coded)
    assert len(coded) == ef.size and [ef.select(i) for i in range(len(values))] == values.tolist()
    for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2 + 1), (5, 5)):
        assert ef.values(a, b).tolist() == values[a:b].tolist()
    n, universe = len(values), int(values[-1])
    assert len(coded) - eliasfano.HEADER.size <= (n * (2 + max(0, math.log2(max(universe, 1) / n)) + 1)) / 8 + 3


def test_elias_fano_edges():
    assert len(eliasfano.EliasFano(eliasfano.encode(np.array([], dtype=np.uint64)))) == 0
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([3, 2]))
    with pytest.raises(IndexError):
        eliasfano.EliasFano(eliasfano.encode(np.array([1]))).select(1)


def test_tokens_equal_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    got = {r.doc_id: r for r in run(spark, "op3_token_output").collect()}
    assert len(got) == len(documents)
    for d in sorted(documents):
        ids = [*tokenizer.encode(documents[d].text, add_special_tokens=False).ids, 2]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


ODD = ["Straße 12,5 don't <|endoftext|> x<|startoftext|>y", "éb ÉCOLE, ÀÉ!? x y z \x1cq", "中文 字, 123abc ABC... ...", "İstanbul ΣΑΣ, ﬁne ½ ² x²", "AB​C'll 'S IT'S", "ǅ ẞ ŉ."]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_words_encode_like_whole_texts(texts):
    coder = token_output.encoder(tokenizer_path())
    for text, ids in zip(texts + ODD, coder.encode_all(texts + ODD)):
        assert ids == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, dtype=coder.type).tobytes()


def test_files_of_bounded_size(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b c " * (i % 5)) for i in range(200)], "doc_id long, text string")
    manifest = token_output.write_tokens(df, tokenizer_path(), 2, str(tmp_path / "out"), file_tokens=50)
    files = manifest.orderBy("file").collect()
    assert len(files) > 10 and files[0].start == 0
    assert all(a.start + a.n_ids == b.start for a, b in zip(files, files[1:]))
    first = token_output.TokenFile(open(files[0].file, "rb").read())
    assert len(first.document(0)) == 1 and first.doc_id(3) == 3 and len(first.document(3)) == 10
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


# --- 4 -----------------------------------------------------------------------


def without_repeats(texts, window):
    seen, out = set(), {}
    for d in sorted(texts):
        words = (texts[d] or "").encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                covered[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, c in zip(words, covered) if not c)
        out[d] = (len(words), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


def test_passages_of_all_documents(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op4_substring_dedup").collect()}
    assert got == without_repeats({d: r.text for d, r in documents.items()}, 20)


@pytest.mark.parametrize("crowded", [2, 10_000])
def test_passages_in_few_words(spark, crowded):
    rng = random.Random(3)
    shared = [rng.choice("abc") for _ in range(40)]
    texts = {i: " ".join([*(rng.choice("abcdefgh") for _ in range(rng.randrange(60))), *shared[rng.randrange(20) : rng.randrange(20, 40)], *(rng.choice("ab") for _ in range(rng.randrange(20)))]) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = substring_dedup.remove_repeats(df, window=8, run=3, shard_words=500, crowded=crowded)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == without_repeats(texts, 8)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=12), min_size=1, max_size=8))
def test_fm_index_finds_the_earliest(sequences):
    index = fm_index.FMIndex(np.array(sum(sequences, []), dtype=np.uint64), np.array([len(s) for s in sequences]), 4)
    place, first, _ = index.earliest()
    seen, want, at = {}, {}, 0
    for s in sequences:
        for i in range(len(s) - 3):
            want[at + i] = seen.setdefault(tuple(s[i : i + 4]), at + i)
        at += len(s) + 1
    assert dict(zip(place.tolist(), first.tolist())) == want


def test_wavelet_ranks():
    symbols = np.random.default_rng(0).integers(0, 37, 3000)
    tree = fm_index.WaveletMatrix(symbols, 37)
    c, i = np.random.default_rng(1).integers(0, 37, 200), np.random.default_rng(2).integers(0, 3001, 200)
    assert tree.rank(c, i).tolist() == [int((symbols[:k] == s).sum()) for s, k in zip(c, i)]


# --- 5 -----------------------------------------------------------------------


def classes_of(texts):
    shingles = {}
    for d, t in texts.items():
        words, times, own = WORD.findall(lower_text(t)), collections.Counter(), {}
        size = min(5, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            g = tuple(words[i : i + size])
            own[(g, times[g])] = i
            times[g] += 1
        shingles[d] = own
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = shingles[a], shingles[b]
            common = x.keys() & y.keys()
            tails = []
            for g in sorted(common, key=x.get):
                at = bisect.bisect_left(tails, y[g])
                tails[at : at + 1] = [y[g]]
            if tails and len(tails) >= 0.8 * (len(x) + len(y) - len(tails)):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_near_classes_of_all_documents(spark, documents):
    got = {r.doc_id: r.class_id for r in run(spark, "op5_near_duplicates").collect()}
    assert got == classes_of({d: r.text for d, r in documents.items()})


def test_near_copies_of_one_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = {}
    for i in range(120):
        own = list(words)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(own)
    for i in range(120, 160):
        texts[i] = " ".join(f"y{rng.randrange(3000)}" for _ in range(rng.randrange(1, 40)))
        texts[i + 100] = texts[i] + " more"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == classes_of(texts)


def test_order_counts():
    a, b = np.arange(100, dtype=np.uint64), np.concatenate([np.arange(50, 100), np.arange(50)]).astype(np.uint64)
    assert near_dedup.chain(a, a, 0.8) == 1.0 and near_dedup.chain(a, b, 0.8) == 0.0
    assert near_dedup.chain(a, a[:80], 0.8) == pytest.approx(0.8)
    x = near_dedup.labelled(a)
    y = near_dedup.labelled(b)
    same = (near_dedup.sketches(x, 6, 64, 1) == near_dedup.sketches(y, 6, 64, 1)).sum()
    assert (near_dedup.sketches(x, 6, 64, 1) == near_dedup.sketches(x, 6, 64, 1)).all() and same < 32


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {n: find(n) for n in parent if find(n) != n or any(find(m) == n and m != n for m in parent)}


# --- 6 -----------------------------------------------------------------------


def test_poisson_counts(spark):
    rows = spark.range(20_000).withColumn("r", F.when(F.col("id") % 2 == 0, 0.7).otherwise(40.0))
    counted = rows.withColumn("n", mixing.poisson_count("s", F.col("r"), F.col("id")))
    for r in counted.groupBy("r").agg(F.avg("n").alias("mean"), F.variance("n").alias("var")).collect():
        assert r.mean == pytest.approx(r.r, rel=0.04) and r["var"] == pytest.approx(r.r, rel=0.08)
    again = rows.withColumn("n", mixing.poisson_count("s", F.col("r"), F.col("id")))
    assert again.exceptAll(counted).count() == 0


def test_poisson_is_the_inverse(spark):
    us = [0.0, 0.1, 0.36, 0.37, 0.5, 0.9, 0.99, 0.999999]
    got = [r.n for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.inverse_poisson(F.col("u"), F.lit(1.0)).alias("n")).collect()]
    want = []
    for u in us:
        n, p, below = 0, math.exp(-1), math.exp(-1)
        while below <= u:
            n += 1
            p /= n
            below += p
        want.append(n)
    assert got == want


def test_mix_meets_the_target(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    out = mixing.mix(docs, mixing.rates(docs, {"hot": 1.0, "s1": 2.0}, default=0.5))
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(n.values())
    assert total == pytest.approx(30_000, rel=0.03)
    weights = {s: 0.5 for s in n} | {"hot": 1.0, "s1": 2.0}
    assert all(n[s] / total == pytest.approx(w / sum(weights.values()), rel=0.06) for s, w in weights.items())
    order = [r.doc_id for r in out.select("doc_id").collect()]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.05


# --- 7 -----------------------------------------------------------------------


def test_contamination_by_brute_force(spark, documents):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = word.findall(lower_text(r.text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in run(spark, "op7_decontamination").collect()}
    assert any(r.contaminated for r in got.values())
    for d, r in documents.items():
        w, hit, items = word.findall(lower_text(r.text)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    items |= own
        want = (len(w), len(hit), len(items), decontaminate.items_sha256(items), bool(hit))
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256, got[d].contaminated) == want


def test_spans_lead_to_the_original(spark):
    text = "Ähm: (one)  TWO,\tthree é four... five"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "two three É?"), ("r", "two three é"), ("s", "four five six")], "item_id string, text string")
    for block_bytes in (1 << 20, 8):  # one automaton, and one for each item
        r = decontaminate.contamination(docs, items, block_bytes=block_bytes).first()
        assert [text[s.begin : s.end] for s in r.hit_spans] == ["TWO,\tthree é"] and r["items"] == ["r"] and r.hit_words == [2, 3, 4]


# --- 8 -----------------------------------------------------------------------


def test_language_accuracy(spark, documents):
    got = run(spark, "op8_language_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(documents) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)


# --- 9 -----------------------------------------------------------------------


def test_bloom_has_no_false_negative_and_the_join_no_false_positive(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    listed = keys.limit(1000)
    for blocks in (1, 64, 4096):
        bloom = url_filter.bloom_table(listed, "k", blocks)
        assert bloom.count() <= blocks
        tested = url_filter.possible_hits(keys, "k", bloom, blocks, "maybe")
        assert tested.join(listed, "k", "left_semi").filter("NOT maybe").count() == 0
    assert tested.filter("maybe").count() < 1300
    pages = keys.select(F.concat(F.lit("http://h.com/"), "k").alias("url"))
    on_list = listed.select(F.concat(F.lit("h.com/"), "k").alias("canonical"))
    verdicts = url_filter.judge(pages, on_list, {}, max_blocks=1)
    assert verdicts.filter("verdict = 'block'").count() == 1000 and verdicts.count() == 3000


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from emberscope.llm import common

    texts = ["a" * 500 + " b " + "c" * 300, None, "", "  x\ty ", "é è"]
    whole = word_hashes(texts)
    monkeypatch.setattr(common, "_BLOCK", 64)
    parts = word_hashes(texts)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist() == [0, 3, 3, 3, 5, 7]
