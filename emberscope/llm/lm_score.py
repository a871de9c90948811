"""Log-probabilities of texts under a log-bilinear model trained by noise-contrastive estimation.

Tokens are words between ASCII white space, A-Z lower-cased, and an end after each text.

The model's outcomes are the most frequent tokens and a fixed number of classes for all
other words, a class being a hash of the word's last two letters and the punctuation after them. An
outcome is predicted from the five outcomes before it: each context place has a diagonal matrix, each outcome
a vector, their products add up to a prediction, and its dot product with an outcome's own vector plus
a bias is the outcome's score. Training contrasts each token with noise drawn from the outcomes' frequencies and so
needs no normaliser; scoring takes the softmax over all outcomes. An outcome's score is a sum over the context places, and what
an outcome at a place adds to all scores is the same wherever it stands; so the exponentials are taken once, by place and outcome, and
a token's normaliser is a sum of their products.

A word of a class has the class's probability times (c + 1) / (N + V + 1), with the word's own count c and the class's
N tokens and V words, so known words and one unknown word for each class add up to 1.

Every task trains on all its training texts, starting from the same parameters; Spark averages the results by number of
tokens, and the next round starts from there. Parameters are of fixed size.

Counts are kept for all words: the most frequent ones (a fixed number) are broadcast, all others
are joined by word and summed by row. Texts are read twice, once to count and once to turn words into outcomes, which are
stored by row; every round of training and the scoring read those.

Null texts are empty and have their end only. Rows with a null id are training rows. Repeated rows count
as often as they stand. With no training text, the counts are 0 and the outcomes equally likely.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import ship

FREQUENT = 1 << 16
TOKENS, CLASSES = 384, 128
OUTCOMES = TOKENS + CLASSES
WIDTH, CONTEXT = 32, 5
ROUNDS, BATCH, NOISE, RATE, SEED = 2, 1024, 48, 0.1, 11
#: Tokens scored in one step, so that the step stays in the processor's cache.
BLOCK = 512
#: The end as a token: no word has white space.
END = "\n"
COUNTER_WORDS = 200_000
#: A sum or product below this may have lost digits to the range of single precision.
LEAST = 1e-30
_PUNCTUATION = ".,;:!?"
_ONES = np.ones(OUTCOMES, dtype=np.float32)
_STEP = float(1 << 24)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, row = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    empty = pc.equal(pc.binary_length(words), 0)  # before leading and behind trailing white space
    return words.filter(pc.invert(empty)), np.bincount(row[~empty.to_numpy(zero_copy_only=False)], minlength=len(texts))


def pieces(sizes: np.ndarray, size: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of rows with about ``size`` in all, to bound the memory of a step."""
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])) if len(sizes) else []


def pieces_of(texts: pa.Array) -> list[tuple[int, int]]:
    return pieces(pc.binary_length(texts).fill_null(0).to_numpy())


def word_class(word: str) -> int:
    """A class by the end of the word; the same in every process."""
    stem = word.rstrip(_PUNCTUATION)
    return TOKENS + zlib.crc32(f"{stem[-2:]} {word[len(stem):][:1]}".encode("utf-8", "surrogatepass")) % CLASSES


def word_classes(words: pa.Array) -> np.ndarray:
    """``word_class`` of each word, taken once for each ending."""
    words = words.cast(pa.string())
    stems = pc.ascii_rtrim(words, characters=_PUNCTUATION)
    last = pc.utf8_slice_codeunits(stems, start=-2).dictionary_encode()
    # the byte behind the stem, 0 where the word ends there
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
    behind = ends[:-1] + pc.binary_length(stems).to_numpy()
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    mark = np.zeros(len(words), dtype=np.int64)
    more = behind < ends[1:]
    mark[more] = data[behind[more]]
    keys, key = np.unique(last.indices.to_numpy().astype(np.int64) * 256 + mark, return_inverse=True)
    tails = last.dictionary.take(pa.array(keys // 256)).to_pylist()
    marks = [chr(k) if k else "" for k in (keys % 256).tolist()]
    return np.array([word_class(t + m) for t, m in zip(tails, marks)], dtype=np.int64)[key]


class Vocabulary:
    """Outcomes and counts of frequent words; ``counts`` is sorted by falling count."""

    def __init__(self, counts: list[tuple[str, int]]):
        self.words = pa.array([w for w, _ in counts], pa.string())
        self.counts = np.array([c for _, c in counts] + [0], dtype=np.float64)  # the last: not frequent
        self.ends = next((c for w, c in counts if w == END), 0)
        top = {END: 0} | {w: i for i, w in enumerate([w for w, _ in counts if w != END][: TOKENS - 1], 1)}
        self.outcome = np.array([top[w] if w in top else word_class(w) for w, _ in counts] + [0], dtype=np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places among the frequent words, -1 for others, and outcomes."""
        at = pc.index_in(words, value_set=self.words.cast(words.type)).fill_null(-1).to_numpy().astype(np.int64)
        outcomes = self.outcome[at]
        others = np.flatnonzero(at < 0)
        outcomes[others] = word_classes(words.take(pa.array(others)))
        return at, outcomes


def stream(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Stored outcomes of all texts, with padding before each and an end after each; where each text begins."""
    lengths = pc.binary_length(rows).to_numpy().astype(np.int64) // 2
    begin = np.concatenate([[0], np.cumsum(lengths + CONTEXT + 1)])
    outcomes = np.frombuffer(b"".join(rows.to_pylist()), dtype="<u2")
    ids = np.full(begin[-1], OUTCOMES, dtype=np.int64)
    ids[np.arange(len(outcomes)) + np.repeat(begin[:-1] + CONTEXT - (np.cumsum(lengths) - lengths), lengths)] = outcomes
    ids[begin[1:] - 1] = 0
    return ids, begin


class Model:
    """Parameters: vectors of context outcomes and of predicted ones, biases, and the context places' diagonals."""

    SHAPES = {"inner": (OUTCOMES + 1, WIDTH), "outer": (OUTCOMES, WIDTH), "bias": (OUTCOMES,), "place": (CONTEXT, WIDTH)}

    def __init__(self, flat: np.ndarray):
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].astype(np.float32).reshape(shape))
            at += size

    @classmethod
    def start(cls, shares: np.ndarray) -> np.ndarray:
        """Small random vectors; biases give the outcomes their shares."""
        rng = np.random.default_rng(SEED)
        parts = [rng.normal(0, 0.1, cls.SHAPES["inner"]), rng.normal(0, 0.1, cls.SHAPES["outer"]), np.log(shares), np.full(cls.SHAPES["place"], 0.5)]
        return np.concatenate([p.ravel() for p in parts])

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.SHAPES]).astype(np.float64)

    def log10_probabilities(self, ids: np.ndarray) -> np.ndarray:
        return Scorer(self).log10_probabilities(ids)


class Scorer:
    """What an outcome at a context place adds to every outcome's score, less the highest of them, and its exponentials.

    The bias is in the first place's.
    """

    def __init__(self, model: Model):
        self.added = (model.inner * model.place[:, None]) @ model.outer.T
        self.added[0] += model.bias
        self.added -= self.added.max(axis=2, keepdims=True)
        self.powers = np.exp(self.added)

    def log10_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Of each token of a stream after the first CONTEXT, normalised; 0 for padding."""
        size, target = len(ids) - CONTEXT, np.minimum(ids[CONTEXT:], OUTCOMES - 1)
        context = [ids[CONTEXT - 1 - i : CONTEXT - 1 - i + size] for i in range(CONTEXT)]
        own, total = np.empty((2, size), dtype=np.float32)
        held, more = np.empty((2, BLOCK, OUTCOMES), dtype=np.float32)
        first = np.arange(BLOCK) * OUTCOMES
        for a in range(0, size, BLOCK):
            b = min(a + BLOCK, size)
            # clip: no id is out of range, and without a check rows go straight into the buffer
            product = self.powers[0].take(context[0][a:b], axis=0, out=held[: b - a], mode="clip")
            for i in range(1, CONTEXT):
                product *= self.powers[i].take(context[i][a:b], axis=0, out=more[: b - a], mode="clip")
            np.matmul(product, _ONES, out=total[a:b])
            product.ravel().take(first[: b - a] + target[a:b], out=own[a:b], mode="clip")
        # where the places' highest scores are far from each other, the scores are added up first
        low = np.flatnonzero((own < LEAST) | (total < LEAST))
        own, total = own.astype(np.float64), total.astype(np.float64)
        own[low] = total[low] = 1.0
        out = np.log10(own / total)
        for a in range(0, len(low), BLOCK):
            k = low[a : a + BLOCK]
            scores = sum(self.added[i].take(c[k], axis=0).astype(np.float64) for i, c in enumerate(context))
            scores -= scores.max(axis=1, keepdims=True)
            out[k] = (scores[np.arange(len(k)), target[k]] - np.log(np.exp(scores).sum(axis=1))) / np.log(10)
        return np.where(ids[CONTEXT:] < OUTCOMES, out, 0.0)


class Trainer:
    """Noise-contrastive steps with AdaGrad on one task's stream."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng([SEED, seed])
        self.cumulative, self.noise_log = np.cumsum(shares), np.log(NOISE * shares).astype(np.float32)
        self.squares = {n: np.full(s, 1e-2, dtype=np.float32) for n, s in Model.SHAPES.items()}
        self.tokens = 0
        # kept from step to step: fresh memory costs as much as the arithmetic
        rows, of_batch = BATCH + CONTEXT, np.empty((4, BATCH, WIDTH), dtype=np.float32)
        self.q, self.own, self.dq, self.part = of_batch
        self.vectors, self.inner = np.empty((2, rows, WIDTH), dtype=np.float32)
        self.wrong = np.empty(BATCH * NOISE, dtype=np.float32)
        self.gradients, self.in_order = np.empty((2, rows + NOISE, 2 * WIDTH), dtype=np.float32)

    def _move(self, name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        s, p = self.squares[name], getattr(self.m, name)
        if rows is None:
            s += gradient * gradient
            p += RATE * gradient / np.sqrt(s)
        else:
            total = s.take(rows, axis=0)
            total += gradient * gradient
            s[rows] = total
            np.sqrt(total, out=total)
            np.divide(gradient, total, out=total)
            total *= RATE
            total += p.take(rows, axis=0)
            p[rows] = total

    def _by_row(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the first gradients by their rows."""
        rows = rows.astype(np.uint16)  # sorted by its digits
        order = np.argsort(rows, kind="stable")
        values = self.gradients.take(order, axis=0, out=self.in_order[: len(rows)], mode="clip")
        rows = rows[order]
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        # complex numbers: two columns are added in one step
        return rows[begin], np.add.reduceat(values.view(np.complex64), begin, axis=0).view(np.float32)

    def step(self, ids: np.ndarray) -> None:
        m, target, n = self.m, ids[CONTEXT:], len(ids) - CONTEXT
        real = target < OUTCOMES
        number = int(np.count_nonzero(real))
        if not number:
            return
        t = target if number == n else np.where(real, target, 0)
        spans = [slice(CONTEXT - 1 - i, CONTEXT - 1 - i + n) for i in range(CONTEXT)]  # place 0: the token just before
        q, own, dq, part, inner = self.q[:n], self.own[:n], self.dq[:n], self.part[:n], self.inner[: n + CONTEXT]
        vectors = m.inner.take(ids, axis=0, out=self.vectors[: n + CONTEXT], mode="clip")
        # rows are multiplied several at once, as a loop over one row is short
        wide = (-1, WIDTH * math.gcd(n, 16))
        diagonals, each = np.tile(m.place, (1, wide[1] // WIDTH)), part.reshape(wide)
        np.multiply(vectors[spans[0]].reshape(wide), diagonals[0], out=q.reshape(wide))
        for i in range(1, CONTEXT):
            np.multiply(vectors[spans[i]].reshape(wide), diagonals[i], out=each)
            q += part
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1])
        drawn = np.bincount(np.minimum(noise, OUTCOMES - 1), minlength=OUTCOMES)
        noise = np.flatnonzero(drawn)  # one column for equal ones
        drawn = drawn[noise]
        other = m.outer.take(noise, axis=0)
        m.outer.take(t, axis=0, out=own, mode="clip")
        right = _sigmoid_of_minus(np.vecdot(q, own) + (m.bias - self.noise_log).take(t))
        wrong = np.matmul(q, -other.T, out=self.wrong[: n * len(noise)].reshape(n, -1))
        wrong += self.noise_log[noise] - m.bias[noise]
        _sigmoid_of_minus(wrong)
        if number < n:
            padding = np.flatnonzero(~real)
            right[padding] = 0
            wrong[padding] = 0
        # equal noise counts as often as it was drawn
        np.multiply(own, right[:, None], out=dq)
        dq -= np.matmul(wrong, other * drawn[:, None].astype(np.float32), out=part)
        # a row for each place, then for the noise; the first columns go to the vectors as context, the others as outcome
        gradients, place = self.gradients[: n + CONTEXT + len(noise)], np.empty_like(m.place)
        inner.fill(0)
        for i, span in enumerate(spans):
            np.multiply(dq.reshape(wide), diagonals[i], out=each)
            inner[span] += part
            place[i] = np.einsum("ij,ij->j", dq, vectors[span])
        gradients[: n + CONTEXT, :WIDTH] = inner
        gradients[n + CONTEXT :, :WIDTH] = 0
        gradients[:CONTEXT, WIDTH:] = 0
        np.multiply(q, right[:, None], out=gradients[CONTEXT : n + CONTEXT, WIDTH:])
        np.multiply(wrong.T @ q, -drawn[:, None], out=gradients[n + CONTEXT :, WIDTH:], casting="same_kind")
        scale = np.float32(1.0 / number)
        rows, values = self._by_row(np.concatenate([ids, noise]))
        values *= scale
        biases = np.bincount(t, right, OUTCOMES)
        biases[noise] -= (np.ones(n, dtype=np.float32) @ wrong) * drawn
        self._move("inner", values[:, :WIDTH], rows)
        outcomes = len(rows) - (rows[-1] == OUTCOMES)  # padding is the last row, and no outcome
        self._move("outer", values[:outcomes, WIDTH:], rows[:outcomes])
        self._move("bias", (biases * scale).astype(np.float32))
        self._move("place", place * scale)
        self.tokens += number

    def train(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids) - CONTEXT, BATCH):
            self.step(ids[a : a + BATCH + CONTEXT])


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place of ``x``."""
    with np.errstate(over="ignore"):  # infinity leads to 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over a column ``text``; the end counts once for each row."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for part in parts:
            texts = part.column(0)
            rows += len(texts)
            for a, b in pieces_of(texts):
                each = words_of(texts.slice(a, b - a))[0].value_counts()
                held.append(pa.table({"word": each.field("values"), "c": each.field("counts")}))
                size += len(each)
                if size >= 2 * COUNTER_WORDS:
                    held = [summed()]
                    size = len(held[0])
                    if size >= COUNTER_WORDS:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if rows:
            held.append(pa.table({"word": pa.array([END], held[0]["word"].type if held else pa.string()), "c": pa.array([rows], pa.int64())}))
            yield from summed().to_batches()

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, number: int) -> list[tuple[str, int]]:
    """The ``number`` first words by falling count, those of one count in order of a hash, and the end.

    Whole levels of counts are taken while they fit; there are 16 to each doubling, so about a thousand at most, and sorting all words on every
    task and sending each one's first to the driver would grow with the tasks. Inside the level that does not fit, the words are cut by their count,
    and of the words of that one count as many come as there is room, by pieces of the hash that are counted in the same way.
    """
    level = F.floor(F.log2(F.col("c")) * F.lit(16)).cast("int")
    end = [(r.word, r.c) for r in counts.filter(F.col("word") == END).collect()]
    counts = counts.filter(F.col("word") != END)
    words: list[tuple[str, int]] = []
    # a level, a count, and pieces of the hash of the word: what still does not fit after all of them are equal hashes
    steps = [-level, -F.col("c"), *(F.shiftrightunsigned(F.xxhash64("word"), 64 - 16 * (i + 1)).bitwiseAND(F.lit(0xFFFF)) for i in range(4))]
    for step in steps:
        room, last = number - len(words), None
        for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.step):
            if r.n > room:
                break
            room, last = room - r.n, r.step
        else:
            r = None
        if last is not None:
            words += [(x.word, x.c) for x in counts.filter(step <= last).collect()]
        if r is None or room == 0:
            break
        counts = counts.filter(step == r.step)
    return sorted(end + words, key=lambda x: (-x[1], x[0]))


def outcome_totals(counts: DataFrame, vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every outcome: OUTCOMES rows at most."""

    def classed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.record_batch({"outcome": vocabulary.value.look_up(part.column(0))[1].astype(np.int32), "c": part.column(1)})

    tokens, kinds = np.zeros(OUTCOMES), np.zeros(OUTCOMES)
    for r in counts.select("word", "c").mapInArrow(classed, "outcome int, c long").groupBy("outcome").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r.outcome], kinds[r.outcome] = r.n, r.v
    return tokens, kinds


def fit(encoded: DataFrame, shares: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` over all rows of ``encoded``, of whose columns ``outcomes`` is read."""
    context = encoded.sparkSession.sparkContext
    flat = Model.start(shares)
    for number in range(rounds):
        start = context.broadcast(flat)

        def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer = Trainer(Model(start.value), shares, number * 1_000_003 + TaskContext.get().partitionId())
            for part in parts:
                rows = part.column(0)
                for a, b in pieces_of(rows):
                    trainer.train(stream(rows.slice(a, b - a))[0])
            if trainer.tokens:
                values = np.append(trainer.m.flat() * trainer.tokens, trainer.tokens)
                yield pa.record_batch({"i": np.arange(len(values), dtype=np.int32), "value": values})

        # in fixed steps, so that the order of adding makes no difference
        summed = encoded.select("outcomes").mapInArrow(train, "i int, value double").groupBy("i").agg(F.sum(F.round(F.col("value") * _STEP).cast("decimal(38,0)")).alias("value"))
        total = np.zeros(len(flat) + 1)
        for r in summed.collect():  # the number of parameters, whatever the corpus
            total[r.i] = float(r.value) / _STEP
        if total[-1] > 0:
            flat = total[:-1] / total[-1]
    return flat


def score_texts(docs: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``learns``: a boolean column; rows where it is not true are held out of all learning.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    training = rows.filter("learns").select("text")
    counts = scratch.put(count_words(training), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums.n or 0, sums.v
    common = most_frequent(counts, frequent)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(common))
    tokens, kinds = outcome_totals(counts, vocabulary)
    shares = (tokens + 1) / (tokens + 1).sum()
    in_class = np.log10(tokens + kinds + 1)
    schema = "doc_id string, held_out boolean, place long, n_tokens long, known long, logs double, inner_logs double, outcomes binary, rare array<string>, times array<long>"

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, k = vocabulary.value, TaskContext.get().partitionId() << 40
        logs_of = np.log10(voc.counts + 1)
        for part in parts:
            texts = part.column("text")
            for a, b in pieces_of(texts):
                words, lengths = words_of(texts.slice(a, b - a))
                coded = words.dictionary_encode()
                code, (at, outcomes) = coded.indices.to_numpy(), voc.look_up(coded.dictionary)
                # what a word adds to its class's probability; nothing for tokens that are outcomes themselves
                inner = np.where(outcomes >= TOKENS, logs_of[at] - in_class[outcomes], 0.0)
                # sums over each text's words; a last 0 serves texts without any
                first = np.concatenate([[0], np.cumsum(lengths)])
                sums = [np.concatenate([[0], np.cumsum(x[code])]) for x in (at >= 0, logs_of[at], inner)]
                known, logs, inner_logs = (s[first[1:]] - s[first[:-1]] for s in sums)
                # a text's distinct words that are not frequent, and how often it has them
                rare = np.flatnonzero(at[code] < 0)
                pairs, times = np.unique(np.repeat(np.arange(b - a), lengths)[rare] * len(at) + code[rare], return_counts=True)
                of_row, of_word = np.divmod(pairs, max(len(at), 1))
                offsets = pa.array(np.searchsorted(of_row, np.arange(b - a + 1)).astype(np.int32))
                stored = outcomes[code].astype("<u2")
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").slice(a, b - a),
                    "held_out": pc.invert(part.column("learns").slice(a, b - a)),
                    "place": k + np.arange(b - a),
                    "n_tokens": lengths + 1,
                    "known": known + (voc.ends > 0),
                    "logs": logs + np.log10(voc.ends + 1),
                    "inner_logs": inner_logs,
                    "outcomes": pa.array([stored[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary()),
                    "rare": pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(of_word))),
                    "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
                })
                k += b - a

    # written once, so a row keeps its number
    encoded = scratch.put(rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(encode, schema), "encoded")
    model = spark.sparkContext.broadcast(fit(encoded.filter("not held_out"), shares, rounds))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = Scorer(Model(model.value))
        for part in parts:
            each = part.column("outcomes")
            for a, b in pieces_of(each):
                ids, begin = stream(each.slice(a, b - a))
                value = np.concatenate([np.zeros(CONTEXT), lm.log10_probabilities(ids)])
                kept = part.slice(a, b - a).drop_columns(["outcomes"])
                yield kept.append_column("value", pa.array(np.add.reduceat(value, begin[:-1])))

    each = encoded.drop("rare", "times")
    scored = each.mapInArrow(score, each.drop("outcomes").schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", value double")
    each = encoded.select("place", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("place", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = each.join(counts, "word").groupBy("place").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    known = scored.join(found, "place", "left")
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    out = known.select(
        F.col("doc_id").cast(dict(docs.dtypes)[doc_id]).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("value") + F.col("inner_logs") + more_logs).alias("score"),
    )
    out = scratch.put(out, "scores")
    scratch.clear(out)
    return out
