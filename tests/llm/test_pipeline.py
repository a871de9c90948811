"""Each stage of the pipeline on the smallest documents, against what it must keep."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_methods import classes_of

import corpus_pipeline
from emberscope.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of every stage."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "token_ids" else before.columns)


def test_language_keeps_texts_with_a_language(spark, stages):
    before, after = stages["language_id"]
    assert after.count() >= 0.99 * before.count()
    junk = spark.createDataFrame([(-1, "123 ... !!", "en", "s", 10), (-2, None, "en", "s", 0)], before.schema)
    kept = corpus_pipeline.language_id(spark, before.union(junk), SMALL)
    assert kept.filter("doc_id < 0").count() == 0


def test_language_rejects_what_was_not_learned(spark, stages):
    before, _ = stages["language_id"]
    rng, russian = np.random.default_rng(3), "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью ".split()
    alphabets = {"latin": [chr(c) for c in range(97, 123)], "cyrillic": [chr(c) for c in range(0x430, 0x450)], "han": [chr(c) for c in range(0x4E00, 0x5E00)]}
    texts = [" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(200)) for letters in alphabets.values() for _ in range(40)]
    texts += [" ".join(rng.permutation(russian * 20)) for _ in range(40)]
    junk = spark.createDataFrame([(-1 - i, t, "", "s", len(t)) for i, t in enumerate(texts)], before.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, before.union(junk), SMALL).select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    # and every document with a letter stays, the short ones, too
    assert kept == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}


def test_one_of_each_class_stays(stages):
    before, after = stages["near_duplicates"]
    classes = classes_of({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_contaminated_go(spark, stages):
    from emberscope.llm.decontaminate import normal_words, windows

    before, after = stages["decontamination"]
    patterns = {w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for w in windows(normal_words(r.text))}
    clean = [r.doc_id for r in before.collect() if not any(b" " + p + b" " in b" " + b" ".join(normal_words(r.text)) + b" " for p in patterns)]
    assert sorted(r.doc_id for r in after.collect()) == sorted(clean)


def test_mixing_repeats_whole_rows(stages):
    before, after = stages["source_mixing"]
    rows, counts = {r.doc_id: r for r in before.collect()}, collections.Counter()
    for r in after.collect():
        assert r == rows[r.doc_id]
        counts[r.doc_id] += 1
    assert after.count() == pytest.approx(before.count(), rel=0.2) and max(counts.values()) > 1


def test_tokens_of_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    before, after = stages["token_ids"]
    start = 0
    for want, got in zip(before.orderBy("doc_id").collect(), after.orderBy("start").collect(), strict=True):
        ids = [*tokenizer.encode(want.text, add_special_tokens=False).ids, 2]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_run_gives_the_same(spark, stages):
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.exceptAll(stages["token_ids"][1]).count() == 0 and whole.count() == stages["token_ids"][1].count()


def test_run_on_no_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
