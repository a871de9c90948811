"""Every operator on nulls in any column, empty and very long texts, repeated rows, no rows, and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from emberscope.llm import ann, decontaminate, langid, line_dedup, lm_score, mixing, near_dedup, substring_dedup, token_output, url_filter
from emberscope.llm.queries import tokenizer_path

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, host string, n_words long, copies int, lang_pred string, __row int, __said string, __rank int, items string, kept string"
)
LONG = "lorem ipsum dolor sit amet " * 20_000


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, 1, 0.5, "h", 7, 3, "x", 1, "s", 2, "i", "k")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        row(1, "The quick brown fox jumps over the lazy dog and runs away from here"),
        row(2, None),
        row(3, ""),
        row(4, " \t\n\r"),
        row(5, LONG),
        row(5, LONG),
        row(None, "no id on this row of words"),
        row(None, None, None, None),
        row(6, "Überall ist heute schönes Wetter für alle Leute", None, None),
        row(7, "12 34 !!"),
        row(8, "one\ntwo\n\none\n", "", ""),
        row(9, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_lm(docs, none):
    got = by_id(lm_score.score_texts(docs, F.col("doc_id") != 1, rounds=1))
    assert sum(map(len, got.values())) == 12
    assert got[2][0].n_tokens == got[3][0].n_tokens == got[4][0].n_tokens == 1
    assert got[1][0].held_out and not got[2][0].held_out and got[None][0].held_out
    assert got[5][0].n_tokens == 100_001 and len(got[5]) == 2
    assert all(r.score <= 0 and r.base_score <= 0 for rows in got.values() for r in rows)
    assert lm_score.score_texts(none, F.lit(True)).count() == 0
    untrained = lm_score.score_texts(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untrained)


def test_nearest(spark):
    big = float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [None, 1.0]), (6, [big, 1.0]), (7, [1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("v", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 9, 1.0), (2, 1, 1, 1.0), (2, 2, 9, 1.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0), (9, 1, 1, 1.0), (9, 2, 2, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


def test_tokens(docs, none):
    got = by_id(token_output.read_tokens(token_output.write_tokens(docs, tokenizer_path(), 2)))
    assert sum(map(len, got.values())) == 12
    assert got[2][0].n_tokens == got[3][0].n_tokens == got[4][0].n_tokens == 1
    assert len({r.start for r in got[5]}) == 2 and len({r.ids_crc32 for r in got[5]}) == 1
    assert min(r.start for r in got[None]) == 0
    assert token_output.read_tokens(token_output.write_tokens(none, tokenizer_path(), 2)).count() == 0


def test_passages(docs, none):
    out = substring_dedup.remove_repeats(docs)
    assert "kept" in out.columns and out.columns.count("n_words") == 1 and out.schema["lang"]
    got = by_id(out)
    assert sum(map(len, got.values())) == 12
    assert got[2][0].n_words == 0 and got[2][0].kept == ""
    # the words repeat every five; only the first windows start nowhere earlier
    assert [r.n_words - r.n_removed for r in got[5]] == [5, 5]
    assert got[1][0].n_removed == 0 and got[9][0].n_removed == 0 and got[None][0].n_removed == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_near(docs, none):
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[9][0].class_id == 1 and got[1][0].class_id == 1
    assert [r.class_id for r in got[5]] == [5, 5] and got[2][0].class_id == 2
    assert [r.class_id for r in got[None]] == [None, None]
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == sorted((d is not None, d or 0) for d in [None, None, 1, 2, 3, 4, 5, 6, 7, 8])
    assert near_dedup.near_duplicates(none).count() == 0


def test_mix(docs, none):
    out = mixing.mix(docs, mixing.rates(docs, {"a": 1.0}, default=1.0, size=40.0))
    assert out.columns[-3:] == ["rate", "copies", "copy_no"] and out.columns.count("copies") == 1
    counts = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert (6, None) in counts and (None, None) in counts and (8, "") in counts and counts[(5, "a")] % 2 == 0
    assert mixing.mix(none, mixing.rates(none)).count() == 0
    assert mixing.mix(docs, mixing.rates(docs, {"a": 0.0, "b": 0.0}, default=0.0)).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "jumps over the LAZY dog"), (2, None), (3, ""), (None, "the quick brown"), (1, "schönes Wetter"), (1, "schönes Wetter")], "item_id long, text string")
    out = decontaminate.contamination(docs, items)
    assert out.columns.count("items") == 1 and out.columns.count("n_words") == 1
    got = by_id(decontaminate.digest(out))
    assert sum(map(len, got.values())) == 12
    assert got[1][0].n_hit == 5 and got[6][0].n_hit == 2 and got[6][0].items_sha256 == decontaminate.items_sha256(["1"])
    assert got[2][0].n_words == 0 and not got[2][0].contaminated and got[2][0].items_sha256 == decontaminate.items_sha256([])
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter(F.size("items") > 0).count() == 0


def test_language(docs, none):
    prototypes = langid.learn(docs)
    assert sorted(prototypes) == ["en"]
    out = langid.identify(docs, prototypes)
    assert out.columns.count("lang_pred") == 1 and out.columns.count("score") == 1
    got = by_id(out)
    for i in (2, 3, 4, 7):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert got[1][0].lang_pred == "en" and all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert langid.learn(none) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_urls(spark):
    urls = ["http://www.A.net/x?y", None, "", "a.net/x", "http://b.example.com/de/1#f", "https://x.org/fr/", "HTTP://Bad.com/p/", "http://bad.com/p", "http://", "http://net"]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, __key string")
    rules = {"net/": "block", "example.com/de/": "block", "org/fr/": "allow"}
    listed = spark.createDataFrame([("bad.com/p",), ("x.org/fr",), (None,), ("bad.com/p",)], "canonical string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, rules).collect()}
    assert len(got) == len(urls)
    assert got["http://www.A.net/x?y"] == ("www.a.net", "/x", "net/", "block")
    assert got[None] == got[""] == got["a.net/x"] == ("", "", None, "allow")
    assert got["http://b.example.com/de/1#f"][2:] == ("example.com/de/", "block")
    assert got["https://x.org/fr/"][2:] == ("org/fr/", "allow")
    assert got["HTTP://Bad.com/p/"][3] == got["http://bad.com/p"][3] == "block"
    assert got["http://net"][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0), listed.limit(0), rules).count() == 0


def test_lines(docs, none):
    extra = docs.withColumn("line", F.lit("x")).withColumn("place", F.lit(1))
    out = line_dedup.remove_lines(extra, 2, site="source")
    assert out.columns[-2:] == ["n_lines", "n_removed"]
    got = by_id(out)
    assert sum(map(len, got.values())) == 12
    # the same line on sites a and b
    assert got[1][0].n_removed == got[9][0].n_removed == 1 and got[1][0].text == ""
    assert got[2][0].text is None and got[2][0].n_lines == 0 and got[3][0].n_lines == 1
    assert got[8][0].n_removed == 0 and got[8][0].text == "one\ntwo\n\none\n" and got[8][0].n_lines == 5
    assert line_dedup.remove_lines(none, 2, site="source").count() == 0
