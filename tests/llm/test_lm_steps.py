"""Steps of operator 1: words by Arrow, scores by the tables of each context place, and what is stored for training."""

import random

import numpy as np
import pyarrow as pa
import pytest

from emberscope.llm import lm_score
from emberscope.llm.common import WORD, lower_text


def test_words_by_arrow_are_those_of_the_pattern():
    rng, letters = random.Random(5), "aZÉ ßİ\t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　\x00."
    texts = [None, "", " ", "\x1f", " A\tb ", *("".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(500))]
    words, lengths = lm_score.words_of(pa.array(texts))
    expected = [WORD.findall(lower_text(t)) if t else [] for t in texts]
    assert lengths.tolist() == [len(e) for e in expected] and words.to_pylist() == [w for e in expected for w in e]


@pytest.mark.parametrize("scale", [0.3, 40.0])  # 40: the scores of one token lie hundreds apart
def test_scores_are_the_softmax(scale):
    rng = np.random.default_rng(3)
    flat = rng.normal(0, scale, sum(int(np.prod(s)) for s in lm_score.Model.SHAPES.values()))
    model = lm_score.Model(flat)
    ids = rng.integers(0, lm_score.OUTCOMES + 1, 700)
    got = lm_score.Scorer(model).log10_probabilities(ids)
    for k in range(0, len(got), 7):
        t = ids[k + lm_score.CONTEXT]
        context = ids[k : k + lm_score.CONTEXT][::-1]
        q = (model.inner[context].astype(float) * model.place.astype(float)).sum(axis=0)
        scores = model.outer.astype(float) @ q + model.bias
        expected = 0.0 if t == lm_score.OUTCOMES else (scores[t] - scores.max() - np.log(np.exp(scores - scores.max()).sum())) / np.log(10)
        assert got[k] == pytest.approx(expected, rel=1e-5, abs=1e-4 * scale)


def test_stored_outcomes_make_the_stream():
    rows = pa.array([np.array(r, dtype="<u2").tobytes() for r in ([3, 500], [], [7])])
    ids, begin = lm_score.stream(rows)
    pad = [lm_score.OUTCOMES] * lm_score.CONTEXT
    assert ids.tolist() == [*pad, 3, 500, 0, *pad, 0, *pad, 7, 0] and begin.tolist() == [0, 8, 14, 21]


def test_classes_of_many_words_are_those_of_each():
    rng, letters = random.Random(6), "abÉß日.,;:!?-"
    words = [*("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(2000)), ".", "a\x00", "\x00"]
    expected = [lm_score.word_class(w) for w in words]
    assert lm_score.word_classes(pa.array(words)).tolist() == expected
    assert lm_score.word_classes(pa.array(words).slice(700)).tolist() == expected[700:]
    assert lm_score.word_classes(pa.array([], pa.string())).tolist() == []
