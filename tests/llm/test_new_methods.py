"""Whitening, conversation repair and fingerprints against brute force, and on rows that are not as they should be."""

import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberscope.llm import dialogue, simhash, whitening

SMALL = "/root/testdata/sf0.001"


def run(spark, name):
    return entry.queries()[name](spark, SMALL)


# --- 11: whitening -----------------------------------------------------------


def _orthogonal(n, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(n) - 0.5 * q.T @ q)
    return q


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 5, 40), np.r_[1, 1 + 1e-9, 1 + 2e-9, np.linspace(2, 3, 20)], np.r_[np.ones(5), 2, 2, 3], np.r_[1e-9, 1e-9 * (1 + 1e-6), 1, 10], np.r_[0, 0, 0, 1.0], np.ones(3)],
)
def test_eigenpairs_to_double_precision(values):
    q = _orthogonal(len(values), 1)
    a = ((q * values) @ q.T).astype(np.float64)
    found, x = whitening.eigenpairs(a)
    top = max(values)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-15 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= 1e-15
    assert np.abs(a @ x - x * found).max() <= 2e-15 * top


def test_refinement_beats_single_precision():
    q = _orthogonal(30, 2)
    a = ((q * np.linspace(1, 2, 30)) @ q.T).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    offs = []
    for _ in range(4):
        x, off = whitening.refine(a, x)
        offs.append(off)
    # the number of right digits about doubles until there are no more
    assert offs[0] > 1e-8 and offs[1] < 1e-11 and offs[2] < 1e-16


def test_whitening_against_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = {r.vec_id: np.floor(64 * np.array(r.embedding, dtype=float)).astype(np.int64) + 1_000_000 for r in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov((fit - sums / n).T, bias=True)
    values, vectors = np.linalg.eigh(v)
    got = run(spark, "op11_whitening").collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    by_component = {k: {r.vec_id: r for r in got if r.component == k} for k in range(1, 17)}
    for k, own in by_component.items():
        e, u = values[-k], vectors[:, -k]
        want = {i: float((y - sums / n) @ u / math.sqrt(e)) for i, y in x.items()}
        sign = np.sign(sum(want[i] * own[i].whitened for i in x))
        assert all(own[i].whitened == pytest.approx(sign * want[i], abs=1e-9) for i in x)
        assert all(r.explained == pytest.approx(e / np.trace(v), rel=1e-9) for r in own.values())
    assert all(r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum()) for r in by_component[1].values())
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_whitening_of_odd_rows(spark):
    big = float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [big, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [3.0, -1.0]), (8, []), (9, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"deviation": F.lit("x"), "__x": F.lit(1), "n": F.lit(2)})
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "__x", "n", "deviation", "whitened"]
    got = sorted(((r.vec_id or 0), r.deviation, len(r.whitened)) for r in out.collect())
    assert model.n == 3 and [g[0] for g in got] == [0, 1, 2, 2] and {g[2] for g in got} == {2}
    assert got[2] == got[3]
    assert whitening.fit(df.limit(0)) is None and whitening.whiten(df, None).count() == 0
    one = whitening.fit(df.filter("vec_id = 2"))
    assert one.n == 1 and [(r.deviation, r.whitened) for r in whitening.whiten(df.filter("vec_id = 2"), one).collect()] == [(0, []), (0, [])]
    # all vectors on one line: one component
    line = spark.createDataFrame([(i, [i / 64, 2 * i / 64, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    flat = whitening.fit(line)
    assert len(flat.values) == 1 and flat.explained == [pytest.approx(1.0)]


def test_deviations_beyond_64_bits(spark):
    far = [(0, [0.0]), (1, [2.0**40])]
    df = spark.createDataFrame(far + [(i, [float(i)]) for i in range(2, 12)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = {i: math.floor(64 * v[0]) + 1_000_000 for i, v in far}
    want = {i: (model.n * x[i] - model.sums[0]) ** 2 for i in x}
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    assert got[1] is None and want[1] >= 1 << 63 and (got[0] == want[0] if want[0] < 1 << 63 else got[0] is None)


def test_fit_from_single_precision_entries(spark):
    df = spark.createDataFrame([(i, [i / 7, -i / 3]) for i in range(50)], "vec_id long, embedding array<float>")
    x = np.array([[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in (i / 7, -i / 3)] for i in range(50)])
    assert whitening.fit(df).sums == x.sum(axis=0).tolist()


# --- 12: conversations -------------------------------------------------------


def cheapest(codes):
    """Least (cost, audit) by uniform-cost search over all edits."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes) and state in (0, 3):
            return cost, audit
        moves = [(x, q) for (p, x), q in dialogue.STEPS.items() if p == state]
        for x, q in moves:
            if x in "ua":
                heapq.heappush(heap, (cost + 3, audit + "I", i, q))
        if i < len(codes):
            code = codes[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            more = 3 if code.isupper() or code == "!" else 0
            for x, q in moves if code != "x" else ():
                if x == code.lower():
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, q))
                if x in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, q))
    return None


def test_parse_against_a_search_of_all_edits():
    for n in range(5):
        for codes in map("".join, itertools.product("suaSUx?!", repeat=n)):
            assert dialogue.parse(codes) == cheapest(codes)
    rng = random.Random(1)
    for _ in range(150):
        codes = "".join(rng.choices("suaSUAx?!", k=rng.randint(5, 60)))
        assert dialogue.parse(codes) == cheapest(codes)


def test_a_span_is_the_same_wherever_it_is_cut():
    """The full chart over all spans and cuts gives the cells that one cut gives."""
    rng = random.Random(2)
    for _ in range(30):
        cells = [dialogue.terminal(c) for c in rng.choices("suaSUAx?!", k=9)]
        full = {(i, i + 1): c for i, c in enumerate(cells)}
        for length in range(2, 10):
            for i in range(10 - length):
                ways = [dialogue.combine(full[i, k], full[k, i + length]) for k in range(i + 1, i + length)]
                assert all(w == ways[0] for w in ways)
                full[i, i + length] = ways[0]
        assert dialogue.chart(cells) == full[0, 9]


def plainly(rows):
    """The contract of the repair, row by row; ``rows``: (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    white, seen, codes, faults = " \t\n\x0b\x0c\r", set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        bare = text.rstrip(white)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        if fault:
            faults[fault] += 1
        codes.append("x" if fault in ("blank", "duplicate") else (initial.upper() if initial != "?" else "!") if fault else initial)
    initials = [r[2][:1] for r in rows]
    illegal = sum("".join(p) not in ("su", "ua", "au") for p in zip(initials, initials[1:]))
    cost, audit = cheapest("".join(codes))
    out, place, state = [], 0, 0
    for edit in audit:
        if edit == "D":
            place += 1
            continue
        role, text = (None, "") if edit == "I" else rows[place][2:]
        role = role if edit == "K" else ("assistant" if state == 2 else "user")
        place += edit != "I"
        state = dialogue.STEPS[state, role[0]]
        out.append(f"{role}:{text}")
    turns = {r[1] for r in rows if r[0]}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_conversations_against_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = damaged(rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in run(spark, "op12_conversation_repair").collect()}
    assert got == {c: plainly([r[1:] for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def digest(df):
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return df.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n").cast("binary"), 256))


def test_odd_conversations(spark):
    long = "word " * 100_000 + "end."
    rows = [
        (1, 5, "user", "Hi."), (1, 1, "system", "Be good."), (1, 9, "assistant", long), (1, None, None, None),
        (2, 1, "User", "Capital."), (2, 2, "", "none"), (2, 2, "", "none"), (2, 2, "assistant", " "),
        (None, 1, "user", "No id?"), (None, 1, "user", "No id?"), (None, None, "user", "x "),
        (3, None, None, None), (3, None, "user", "  \t\r\n"),
        (4, -(1 << 63), "user", "a!"), (4, (1 << 63) - 1, "assistant", "b!"),
        *[(5, i, ("user", "assistant")[i % 2] if i % 7 else "system", f"t {i % 40}" + ("." if i % 5 else "")) for i in range(300)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit("x"), "__rows": F.lit(1), "__found": F.lit(1)})
    out = dialogue.repair(df.repartition(5))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in digest(out).collect()}
    want = {c: plainly([r[1:] for r in rows if r[0] == c]) for c in (1, 2, None, 3, 4, 5)}
    want[4] = (None, *want[4][1:])  # beyond 64 bits
    assert got == want
    assert dialogue.repair(df.limit(0)).count() == 0
    absent = dialogue.repair(df.filter("conv_id = 1"), present=F.lit(False)).first()
    assert (absent.gaps, absent.blank, absent.cost, absent.audit, absent.repaired) == (0, 0, 0, "", [])


def test_damage_of_nulls(spark):
    rows = [(None, t, None, None) for t in range(40)] + [(c, None, "assistant", "a.b!c?") for c in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out, present = dialogue.damage(df)
    assert sorted(str(tuple(r)[:4]) for r in out.filter(present).collect()) == sorted(map(str, damaged(rows)))
    assert {r.conv_id for r in out.collect()} == {r[0] for r in rows}


# --- 13: fingerprints --------------------------------------------------------


def brute_print(text):
    """Votes term by term."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    pieces = [w[i : i + 16] for w in low.split(" ") if w for i in range(0, len(w), 16)]
    votes = [0] * 128
    for a, b in zip(pieces, [*pieces[1:], ""]):
        first = xxhash.xxh64_intdigest(f"{a} {b}".encode(), seed=42)
        second = xxhash.xxh64_intdigest(first.to_bytes(8, "little"), seed=42)
        for half, h in enumerate((first, second)):
            for bit in range(64):
                votes[half * 64 + 63 - bit] += len(a) if h >> bit & 1 else -len(a)
    return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):032x}"


def like(a, b):
    bits = (int(a, 16) ^ int(b, 16)).bit_count()
    return round(max(0.0, math.cos(math.pi * bits / 128)), 6)


def contract(rows):
    """What the query returns for (doc_id, text) with distinct ids, in order of id."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        k = len(text) // 4
        changed = text[: len(text) - k] + after[:k]
        a, b, c = map(brute_print, (text, changed, after))
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, like(a, b), like(a, c))
    return out


FOUND = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def same(got, want):
    assert set(got) == set(want)
    for i, row in want.items():
        assert got[i][:4] == row[:4], i
        assert got[i][4:] == pytest.approx(row[4:], abs=2e-6)


def test_fingerprints_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r[c] for c in FOUND) for r in run(spark, "op13_fingerprints").collect()}
    same(got, contract(rows))
    assert np.mean([g[4] > g[5] for g in got.values()]) > 0.95


def test_fingerprints_of_odd_texts(spark):
    rows = [
        (1, "The quick brown fox"), (2, None), (3, ""), (4, " \t\n\r "), (5, "ä中\U0001f600" * 30), (6, "x" * 100_000), (7, "lorem ipsum " * 20_000),
        (8, "A"), (9, "a"), (10, "one\x00two \x1f three four"), (11, "the QUICK brown fox"), (12, "abcd efgh"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"own": F.lit(1), "fingerprint": F.lit("x"), "place": F.lit(2)})
    got = {r.doc_id: tuple(r[c] for c in FOUND) for r in simhash.compare_edited(df.repartition(6)).collect()}
    same(got, contract(rows))
    assert got[2][2] == got[3][2] == got[4][2] == "0" * 32 and got[1][2] == got[11][2]
    own = simhash.fingerprint(df)
    assert own.columns == ["doc_id", "text", "own", "place", "fingerprint"]
    assert {r.doc_id: r.fingerprint for r in own.collect()} == {i: brute_print(t) for i, t in rows}


def test_documents_without_order(spark):
    rows = [(None, "no id here at all"), (None, "no id here at all"), (None, "another one without"), (1, "same"), (1, "same"), (1, "not the same text"), (2, "last")]
    got = simhash.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    # rows of one id and text are one document
    assert len({tuple(r) for r in got}) == 5
    last = next(r for r in got if r.doc_id == 2)
    first = sorted({t for i, t in rows if i is None}, key=lambda t: hashlib.sha256(t.encode()).hexdigest())[0]
    assert last.edited_sha256 == hashlib.sha256(f"las{first[0]}".encode()).hexdigest()
    assert simhash.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = simhash.compare_edited(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_search_within_a_radius_misses_nothing(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(30)]
    for p in list(prints):
        for flips in range(10):
            near = p
            for bit in rng.sample(range(128), flips):
                near ^= 1 << bit
            prints.append(near)
    texts = [f"{p:032x}" for p in prints]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "fingerprint string")
    queries = df.limit(40)
    wanted = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in {r[0] for r in queries.collect()} for b in set(texts)}
    got = [tuple(r) for r in simhash.within(queries, df, radius).collect()]
    assert sorted(got) == sorted(w for w in wanted if w[2] <= radius)
    with pytest.raises(ValueError):
        simhash.within(df, df, 40)


def test_no_python_on_the_native_path(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = simhash.compare_edited(docs)._jdf.queryExecution().executedPlan().toString() + simhash.fingerprint(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
