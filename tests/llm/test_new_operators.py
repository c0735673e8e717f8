"""Compressed-register near copies, importance resampling and filter interactions against brute force."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import filter_audit, hyperminhash, importance, langid
from tests.llm.test_llm import HARD, empty, hard  # noqa: F401  (fixtures)

# --- HyperMinHash -----------------------------------------------------------------------


def brute_groups(texts):
    """Component of every document (id -> text) by all pairs of whole sets."""
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if (w := t.lower().split()) else frozenset() for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def cloud(rng, count, length, most):
    """Near copies of one text, with none to ``most`` words replaced."""
    base = [f"w{rng.randrange(900)}" for _ in range(length)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(most + 1)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block_shingles", [hyperminhash.BLOCK_SHINGLES, 4096])
def test_groups_equal_brute_force(spark, block_shingles):
    rng = random.Random(5)
    texts = cloud(rng, 150, 80, 6) + cloud(rng, 60, 300, 12) + [" ".join(f"r{rng.randrange(500)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += ["the same short line", "the same short line", "the same short", "", "  ", "The SAME short line"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), block_shingles=block_shingles).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(dict(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hard_rows_have_defined_groups(hard, empty):  # noqa: F811
    got = hyperminhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD) and hyperminhash.near_duplicates(empty).count() == 0
    found = {r.doc_id: r for r in got}
    assert (found[4].component_id, found[1].kept, found[4].kept) == (1, True, False)
    assert [found[i].n_shingles for i in (2, 3, 5, 7)] == [0, 0, 1, 0] and found[None].component_id is None and not found[None].kept
    assert hyperminhash.one_of_each(hard).count() == len(HARD) - 2


def test_an_id_with_two_texts_is_one_document(spark):
    one, two = "a b c d e f g", "h i j k l m n"
    rows = spark.createDataFrame([(9, one), (9, two), (3, one), (5, two), (7, "q r s t u")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(rows).collect()} == {(9, 3), (3, 3), (5, 3), (7, 7)}


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(100):
            pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
            a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[: int(2000 * share)], pool[2000 : 4000 - int(2000 * share)]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = hyperminhash.registers(a), hyperminhash.registers(b)
            used = ((x != 0) | (y != 0)).sum()
            guess = hyperminhash.estimated(np.array(((x == y) & (x != 0)).sum()), used, np.array(len(a)), np.array(len(b)))
            errors.append((float(guess) - true) / math.sqrt(true * (1 - true) / used))
    assert abs(np.mean(errors)) < 0.3 and np.std(errors) < 1.3 and max(map(abs, errors)) < hyperminhash.ERRORS


def test_registers_hold_zeros_and_mantissa():
    value = (1 << 50) + (3 << 39)  # the leading one of 51 bits, then 0000000001 1...
    regs = hyperminhash.registers(np.array([value * hyperminhash.BUCKETS + 7, (1 << 55) * hyperminhash.BUCKETS + 7], np.uint64))
    assert regs[7] == ((64 - 51) << 10) + (3 << 39 >> 40) + 1 and (np.delete(regs, 7) == 0).all()


# --- importance resampling --------------------------------------------------------------


def brute_resample(rows, target, percent=10, least=20):
    def words(t):
        return importance.words_of((t or "").encode())

    def counted(texts):
        out = [0] * 10_000
        for t in texts:
            for w in words(t):
                out[zlib.crc32(w) % 10_000] += 1
        return out

    s, t = counted(x for _, x in rows), counted(target)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 10_000) / ((s[i] + 1) * (sum(t) + 10_000)))) for i in range(10_000)]
    scored = []
    for i, x in rows:
        found = [gain[zlib.crc32(w) % 10_000] for w in words(x)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    ranks = fit[: percent * len(fit) // 100]
    out = [(*r, k + 1) for k, r in enumerate(ranks)]
    rest = list(scored)
    for r in ranks:
        rest.remove(r)
    return sorted(out + [(*r, None) for r in rest], key=repr)


@pytest.mark.parametrize(("segments", "percent"), [(1, 10), (5, 40), (16, 100), (7, 0)])
def test_ranks_equal_brute_force(spark, segments, percent):
    rng = random.Random(3)
    rows = [(rng.randrange(200) if rng.random() < 0.9 else None, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [(77, "a b c " * 9)] * 80 + [(5, None)]
    target = ["w1 w2 w3 w4 w1 w1", None, "a"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, segments=segments).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_resample(rows, target, percent)


def test_resampling_of_hard_rows(spark, hard, empty):  # noqa: F811
    target = spark.createDataFrame([("the cat",)], "text string")
    got = importance.resample(hard, target, percent=50).collect()
    assert len(got) == len(HARD) and sum(r.rank is not None for r in got) == 0  # one text of 20 words or more
    assert [r.doc_id for r in importance.resample(hard, target, percent=100).collect() if r.rank] == [6]
    assert importance.drawn(hard, target, percent=100).columns == hard.columns
    for docs, aim in ((empty, target), (hard, target.limit(0)), (empty, target.limit(0))):
        assert importance.resample(docs, aim).count() == docs.count()
    with pytest.raises(ValueError):
        importance.resample(hard.withColumn("doc_id", hard.doc_id.cast("string")), target)


def test_longer_runs_are_features(spark):
    docs = spark.createDataFrame([(1, "A b, c"), (2, "x")], "doc_id bigint, text string")
    got = importance.resample(docs, docs, longest=2, min_words=3, percent=100).collect()
    assert {r.doc_id: (r.n_features, r.rank) for r in got} == {1: (5, 1), 2: (1, None)}


# --- filter interactions ----------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.booleans()), max_size=60))
def test_walk_equals_brute_force(rows):
    cells = np.zeros((32, 2), np.int64)
    for mask, good in rows:
        cells[mask] += (1, good)
    states = filter_audit.survivors(cells)
    for subset in range(32):
        assert states[subset].tolist() == [sum(m & subset == 0 for m, _ in rows), sum(m & subset == 0 and g for m, g in rows)]
    found = filter_audit.steps_of(cells, list("ABCDE"))
    at = 0
    shapley = dict.fromkeys("ABCDE", 0)
    for order in permutations(range(5)):
        left = list(rows)
        for step, bit in enumerate(order):
            gone = [r for r in left if r[0] >> bit & 1]
            left = [r for r in left if not r[0] >> bit & 1]
            fails = sum(m >> bit & 1 for m, _ in rows)
            assert (found["filter_order"][at], found["step"][at]) == ("".join("ABCDE"[b] for b in order), step + 1)
            assert (found["kept"][at], found["removed"][at], found["redundant"][at]) == (len(left), len(gone), fails - len(gone))
            assert found["unique_fails"][at] == sum(m == 1 << bit for m, _ in rows) and found["lost"][at, 0] == sum(g for _, g in gone)
            shapley["ABCDE"[bit]] += len(gone)
            at += 1
    assert all(found["shapley"][k] == shapley[found["filter_order"][k][found["step"][k] - 1]] for k in range(at))


def test_audit_of_hard_rows(spark, hard, empty):  # noqa: F811
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (4, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(hard, labels).collect()}
    assert len(got) == 600 * 3 and filter_audit.audit(empty, labels).count() == 0
    # without E, nothing is a copy; both rows of document 4 have the text of document 1
    assert {p: got[p, "EABCD", 1].removed for p in ("", "en", "ja")} == {"": 3, "en": 0, "ja": 0}
    assert got["", "EABCD", 1].good_lost == 2 and got["", "EABCD", 1].toxic_lost == 2
    assert (got["en", "ABCDE", 1].kept, got["en", "ABCDE", 1].removed) == (1, 5)
    assert got["en", "BACDE", 1].removed == 1 and got["en", "ABCDE", 1].good_lost == 1
    assert filter_audit.audit(hard, labels.limit(0)).filter("good_lost > 0").isEmpty()


def test_flags_of_texts(spark):
    texts = ["a " * 199 + "b", "a b " * 100, "x" * 97 + "ABC", "x" * 96 + "ABCD", "50% off", "\x0ba\x0cb\x1cc", "é" * 97 + "ABC"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    flags = filter_audit.text_flags(rows.text)
    got = ["".join(n for n in "ABCD" if r[n]) for r in rows.select("i", *(c.alias(n) for n, c in flags.items())).orderBy("i").collect()]
    assert got == ["B", "B", "A", "AC", "AD", "A", "A"]


def test_filters_are_checked(spark):
    rows = spark.createDataFrame([(1, "x")], "a int, part string")
    for filters in ({}, {"AB": rows.a > 0}):
        with pytest.raises(ValueError):
            filter_audit.interactions(rows, "part", filters)
    one = filter_audit.interactions(rows, "part", {"A": rows.a > 0}).collect()
    assert [(r.kept, r.removed, r.shapley) for r in one] == [(0, 1, 1)]


# --- language identification ------------------------------------------------------------


def test_any_number_of_languages_is_learned(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 9, f"l{i % 300:03}") for i in range(1500)] + [(9_999, "same row " * 9, "l000")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.training_rows(docs, rows_per_language=3)
    assert len({lang for lang, _ in found}) == 300 and len(found) == 900
    assert sum(piece == b"same row " * 9 for _, piece in found) <= 1
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 400)
    assert len(langid.training_rows(docs, rows_per_language=3)) == 300
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 100)
    some = langid.training_rows(docs, rows_per_language=3)
    assert len(some) == 100 and "l000" in {lang for lang, _ in some}
