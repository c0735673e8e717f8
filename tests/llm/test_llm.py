"""The operators of the training-data pipeline against brute force, round trips and hard cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tamis.llm import chat, components, decontaminate, langid, licences, neighbours, pieces, pii, queries, sharding, simhash, token_files

FOLDER = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path(pieces.VOCABULARY)
TOKENS = public_tokenizers.path(token_files.VOCABULARY)
# Nulls in any column, empty, blank, very long, repeated rows, texts of no language.
HARD = [
    (1, "one two three four five six", "en", "s"),
    (2, "", "en", None),
    (3, None, None, "s"),
    (4, "one two three four five six", None, "s"),
    (4, "one two three four five six", None, "s"),
    (5, "x" * 90_000, "en", "s"),
    (6, "the cat sat on the mat " * 9_000, "en", "s"),
    (7, " \t\n ", "en", "s"),
    (8, "日本語 ▁ mail a@b.co", "ja", "s"),
    (None, "a row without an id", "en", "s"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def hard(spark):
    """With extra columns whose names clash with the operators' own."""
    rows = spark.createDataFrame(HARD, SCHEMA)
    return rows.selectExpr("*", "'a' AS id", "1 AS size", "2 AS shard", "3 AS row", "'b' AS spans", "0.5 AS score", "9L AS n_chars", "'c' AS items")


@pytest.fixture(scope="module")
def empty(hard):
    return hard.limit(0)


def texts():
    return [t or "" for _, t, _, _ in HARD]


# --- personal data ---------------------------------------------------------------------


def brute_spans(text):
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    found = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "%", "1", "25", "256", "007", " ", "+", "(", "é", "4111111111111111", "@b.c"]), max_size=25).map("".join))
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain_spans(text) == brute_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jоhn@example.com now", "email", "jоhn@example.com"),
        ("write to bob [at] example [dot] com please", "email", "bob [at] example [dot] com"),
        ("bob at example dot com.", "email", "bob at example dot com"),
        ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
        ("Call plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
        ("at one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("pay ４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguised_spans_keep_source_places(text, kind, found):
    base, every = pii.all_spans(text)
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]


@pytest.mark.parametrize("text", ["look at the dot on the map", "we met at ten dot then left", "me at example.com", "one two three", "", "dot dot dot"])
def test_prose_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize("local", ["mary dot ann dot smith", "mary dot ann.smith", "mary.ann dot smith", "a [dot] b dot c dot d"])
def test_every_dot_of_a_local_part_is_undone(local):
    assert pii.masked_text(f"mail {local} at example dot com") == "mail <EMAIL>"


def test_mask_keeps_rows_and_columns(hard, empty):
    got = pii.mask(hard).collect()
    assert len(got) == len(HARD) and pii.mask(empty).count() == 0
    assert {r.text for r in got if r.doc_id == 8} == {"日本語 ▁ mail <EMAIL>"}
    assert pii.find_personal_data(hard).count() == len(HARD)


# --- near-duplicates -------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall("[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), seed=42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    owner = dict(fps)
    label = {i: i for i in owner}
    changed = True
    while changed:
        changed = False
        for i in owner:
            for j in owner:
                if bin(owner[i] ^ owner[j]).count("1") <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    near = [t + " tail" for t in base if len(t) > 150] + [t.upper() for t in base[:5]]
    rows = [(i, t) for i, t in enumerate([*base, *near, *base[:9], "", None])]
    want_fp = {i: brute_fingerprint(t or "") for i, t in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{fp:016x}" for i, fp in want_fp.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(want_fp)


@pytest.mark.parametrize("dense", [False, True])
def test_links_join_all_near_fingerprints(spark, dense):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 1 if dense else 300, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << b for b in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())) for s in seeds for _ in range(900 if dense else 4)}
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(sorted(fps))]
    classes = spark.createDataFrame(rows, "node bigint, fp bigint")
    # small shards and blocks, so that fingerprints visit several
    found = {r.node: r.component for r in components.components(simhash.links(classes, shard_rows=50, block_rows=200)).collect()}
    values = np.array(sorted(fps), np.uint64)
    label = np.arange(len(values))
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    for _ in range(len(values)):
        new = np.where(close, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [found.get(i, i) for i in range(len(values))] == label.tolist()


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(200)] + [(7, 7), (900, 901), (900, 901)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_handles_hard_rows(hard, empty):
    kept = simhash.one_of_each(hard).select("doc_id").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, 5, 6, 8, None], key=str)
    assert simhash.one_of_each(empty).count() == 0
    assert simhash.near_duplicates(hard).count() == len(HARD)


# --- sentence pieces -------------------------------------------------------------------


def chunked_ids(text, size, encoder):
    form, margin, cut = pieces.normalised(text), encoder.words.longest, []
    for low in range(0, len(form), size):
        high, begin = min(len(form), low + size), max(0, low - margin)
        cut.append((form[begin : high + margin], low - begin, high - begin))
    if not cut:
        return []
    outs = pieces._resolve([pieces.transfer(*c, encoder.words) for c in cut], 0, None)
    return [i for c, a, b in zip(cut, [0, *outs], outs) for i in np.frombuffer(pieces.backtrace(*c, a, b, encoder), "<u4").tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "   ", "the", "ing", "é", "\n", "▁", "日本", "1", ".", "😀", "tion", "in", "er", "qu"]), max_size=40).map("".join), st.integers(1, 40))
def test_scan_equals_the_library(text, size):
    encoder = pieces.encoder_of(PIECES)
    want = encoder.words.model.encode(text)
    assert chunked_ids(text, size, encoder) == want
    assert np.frombuffer(encoder.encode([pieces.normalised(text)])[0], "<u4").tolist() == want
    assert pieces.decode(np.array(want, np.uint32), encoder.words)[1:].decode() == text.replace("▁", " ")


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.3, -np.inf, rng.normal(size=s)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.allclose(pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c)))


@pytest.mark.parametrize("chunk", [pieces.CHUNK, 1000])
def test_documents_round_trip(hard, empty, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.round_trip(hard, keep=("source",), chunk=chunk).collect()
    assert len(got) == len(HARD) and all(r.round_trip for r in got)
    want = sorted((zlib.crc32(np.array(model.encode(t), "<u4").tobytes()), len(t)) for t in texts())
    assert sorted((r.ids_crc32, r.n_chars) for r in got) == want
    assert pieces.round_trip(empty).count() == 0


@pytest.mark.parametrize("chunk", [pieces.CHUNK, 1000])
def test_ids_of_documents_are_returned(spark, hard, empty, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(i), model.encode(t or "")) for i, t, _, _ in HARD)

    def ids(rows):
        """The ids of every document, chunks in order."""
        found = {}
        for n, r in enumerate(sorted(rows, key=lambda r: r.chunk)):
            found.setdefault((str(r.doc_id), n if r.row is None else f"giant {r.row}"), []).extend(np.frombuffer(r.ids, "<u4").tolist())
        return sorted((i, own) for (i, _), own in found.items())

    proved = pieces.encode_proved(hard, keep=("source",), chunk=chunk).collect()
    assert ids(proved) == want and all(r.round_trip for r in proved)
    for r in proved:
        if r.row is None:
            assert (r.n_tokens, r.ids_crc32) == (len(r.ids) // 4, zlib.crc32(r.ids))
    whole, cut = pieces.encode(hard, chunk=chunk)
    assert ids([*whole.withColumnRenamed("id", "doc_id").collect(), *cut.withColumnRenamed("id", "doc_id").collect()]) == want
    found = pieces.digests(whole, cut).collect()
    sums = sorted((str(i), len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for i, own in want)
    assert sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in found) == sums
    assert pieces.encode_proved(empty).count() == 0


def test_queries_return_ids(spark, hard):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = {r.doc_id: r.ids for r in queries.op3_sentencepiece(spark, FOLDER).filter("row IS NULL").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert some and all(np.frombuffer(own, "<u4").tolist() == model.encode(docs[i]) for i, own in some.items())
    last = corpus_pipeline.sentencepiece(spark, hard, FOLDER)
    assert "ids" in last.columns and last.filter("ids IS NULL").isEmpty()


# --- shards ----------------------------------------------------------------------------


def test_shards_of_near_equal_bytes(spark, hard, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    copies = spark.range(3000).selectExpr("id + 100000 AS doc_id", "'the same text, many times' AS text")
    rows = sharding.shard_by_bytes(docs.unionByName(copies), 7).collect()
    sizes, slots = {}, {}
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 16
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows) + 0.002 * sum(sizes.values()) / 7
    assert sharding.shard_by_bytes(hard, 3).count() == len(HARD) and sharding.shard_by_bytes(empty, 3).count() == 0


def test_slots_by_ranges_equal_those_of_one_range(spark, hard):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    copies = spark.range(3000).selectExpr("id + 100000 AS doc_id", "'the same text, many times' AS text")
    docs = docs.unionByName(copies).withColumn("Slot", F.lit("its own"))
    want = sharding.shard_by_bytes(docs, 5)
    got = sharding.shard_by_bytes(docs, 5, range_bytes=2000)
    assert got.columns == ["doc_id", "text", "size", "shard", "slot"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # rows that repeat an id and a text share a range
    assert sorted(r.slot for r in sharding.shard_by_bytes(hard.unionByName(hard), 1, range_bytes=20).collect()) == list(range(2 * len(HARD)))


def test_registered_shards(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_shards"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- benchmark passages ----------------------------------------------------------------


def brute_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        size = min(13, len(own))
        for low in range(len(own) - size + 1) if size else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[low : low + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["a", "B", "c,", "é", "7"]) for _ in range(n))
    items = [("long", words(20)), ("x", words(13)), ("short", words(4)), ("one", "zebra"), ("none", "!!"), ("null", None), ("copy", None)]
    items[-1] = ("copy", items[0][1])
    docs = [(i, words(rng.randint(0, 60)) + (" " + items[i % 3][1] + " " + words(5) if i % 2 else "")) for i in range(40)] + [(40, None), (41, "Zebra"), (41, "Zebra")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), bench, block_bytes=block_bytes).collect()
    want = []
    for i, t in docs:
        n, hit, found = brute_contamination(t, items)
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_contamination_of_hard_rows(hard, empty):
    bench = hard.selectExpr("doc_id AS item_id", "text")
    assert decontaminate.contamination(hard, bench).filter("contaminated").count() == 7
    # repeated benchmark rows change nothing, and do not count for the size of the lists
    many = bench
    for _ in range(3):
        many = many.unionByName(many)
    count, blocks = decontaminate._blocks(many, "item_id", "text", 1 << 20)
    distinct = {(r.item_id if r.item_id is None else str(r.item_id), r.text) for r in bench.collect() if r.text is not None}
    assert count == 1 and sorted(next(blocks), key=str) == sorted(distinct, key=str)
    once, often = (sorted(decontaminate.contamination(hard, b).collect(), key=str) for b in (bench, many))
    assert once == often
    assert decontaminate.clean(hard, empty.selectExpr("doc_id AS item_id", "text")).columns == hard.columns
    assert decontaminate.clean(empty, bench).count() == 0


# --- token files -----------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'re", " ", "\n", "\t", "é", "É", "ß", "İ", "<|endoftext|>", "<|", "日本", "1", "23", "!!", "a", "The", "º", "\xa0", "\x1c", "😀", "I'LL", "÷"]), max_size=12).map("".join))
def test_ids_equal_the_library(text):
    encoder = token_files.encoder_of(TOKENS)
    assert np.frombuffer(encoder.encode([text], 2)[0], encoder.wide).tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1).flatmap(lambda n: st.sampled_from([n, n % 65536, n % 256]))))
def test_codes_round_trip(numbers):
    values = np.array(numbers, np.uint32)
    assert token_files.unpack(*token_files.pack(values), len(values)).tolist() == numbers


def test_token_files(hard, empty):
    tokenizer = Tokenizer.from_file(TOKENS)
    start, want = 0, []
    for i, t in sorted(((i, t or "") for i, t, _, _ in HARD), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.round_trip(hard).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.round_trip(empty).count() == 0


# --- language --------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op7_language(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_hard_rows(hard, empty):
    model = langid.train([("en", b"the cat sat on the mat with the hat"), ("fr", "le chat était sur la table avec une".encode())], n_steps=60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.classify(hard, model).collect()}
    assert got[3] == got[2] == got[7] == ("und", 0.0) and got[6][0] == "en"
    assert langid.fit(hard.filter("lang IS NULL")) is None and langid.fit(empty) is None
    assert {r.lang_pred for r in langid.classify(hard, None).collect()} == {None, "und"}


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = langid.train([("a", b"abcabcabc" * 9), ("b", b"xyzxyzxyz" * 9)], n_steps=3)
    x, y = rng.integers(97, 123, (4, langid.WINDOW)), np.array([0, 1, 1, 0])

    def loss():
        hidden = langid.pooled(x.astype(np.uint8), model, [t.astype(np.float64) for t in model.tables()])
        p = langid.softmax(hidden @ model.out + model.bias)
        return -np.log(p[np.arange(4), y]).mean()

    grads = langid._gradients(model, x, y)
    for value, grad in ((model.out, grads[-2]), (model.bias, grads[-1])):
        at = (0,) * value.ndim
        value[at] += 1e-4
        high = loss()
        value[at] -= 2e-4
        low = loss()
        value[at] += 1e-4
        assert abs((high - low) / 2e-4 - grad[at]) < 1e-3


# --- neighbours ------------------------------------------------------------------------


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, matrix = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.op8_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.linalg.norm(matrix - matrix[ids == q][0], axis=1)
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [rank for rank, _, _ in sorted(got[q])] == list(range(1, 11))
        hits, total = hits + len(set(best) & {v for _, v, _ in got[q]}), total + 10
    assert hits >= 0.98 * total


def test_bit_counts_estimate_inner_products():
    draw = np.random.default_rng(3)
    for dim in (5, 64, 100):
        signs, asked = draw.integers(0, 2, (50, dim)), draw.normal(size=(7, dim)) * 3 + 1
        got, error = neighbours.signed_sums(neighbours.words(np.packbits(signs, axis=1, bitorder="little")), asked)
        gap = np.abs(got - asked @ (signs * 2 - 1).T)
        assert (gap <= error[:, None] * np.sqrt(12) / 2 * dim + 1e-9).all()
        assert gap.mean() < 2 * (error * np.sqrt(dim)).mean()
    same = neighbours.signed_sums(neighbours.words(np.array([[5]], np.uint8)), np.full((1, 3), 2.0))
    assert same[0].tolist() == [[2.0]] and same[1].tolist() == [0.0]


def test_codes_leave_vectors_out():
    matrix = np.array([r for r in duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchnumpy()["embedding"]], np.float64)
    middle = matrix.mean(axis=0)
    packed, norms, agree = neighbours.codes(matrix, middle)
    asked = np.arange(0, len(matrix), 20)
    own = asked[:, None] == np.arange(len(matrix))
    keep = neighbours.candidates(neighbours.words(packed), norms, agree, matrix, matrix[asked], middle, own, 10)
    assert not keep[own].any() and keep.mean() <= 0.4
    hits = 0
    for q, kept in zip(asked, keep):
        d = np.linalg.norm(matrix - matrix[q], axis=1)
        d[q] = np.inf
        hits += kept[np.argsort(d, kind="stable")[:10]].sum()
    assert hits >= 0.98 * 10 * len(asked)
    # copies of a query are never left out
    twice = np.concatenate([matrix, matrix[:20]])
    packed, norms, agree = neighbours.codes(twice, middle)
    own = np.arange(20)[:, None] == np.arange(len(twice))
    keep = neighbours.candidates(neighbours.words(packed), norms, agree, twice, twice[:20], middle, own, 10)
    assert keep[np.arange(20), len(matrix) + np.arange(20)].all()


def test_neighbours_of_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 7, 0.0), (0, 3, 8, 2**0.5)]
    assert neighbours.nearest(vectors.limit(0), vectors).count() == 0
    with pytest.raises(ValueError):
        ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], vectors.schema)
        neighbours.nearest(ragged, ragged)


# --- licences --------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "general", "public", "license", "Apache", "cc", "by", "MIT", "mit-license", "x", "é"]), max_size=30))
def test_base_phrases_equal_brute_force(parts):
    text = " ".join(parts)
    words = [w.decode() for w in licences.words_of(text.encode())]
    places = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    got = licences.scan_text(text.encode(), licences.automaton(), frozenset(licences.PERMISSIVE))
    assert (got["n_words"], got["n_base"]) == (len(words), len(places))
    assert (got["first_word"], got["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
    assert got["base_labels"] == ",".join(sorted({label for _, label in places}))


@pytest.mark.parametrize(
    ("expression", "named", "usable"),
    [
        ("MIT", {"mit"}, True),
        ("GPL-2.0-only OR MIT", {"gpl-2.0-only", "mit"}, True),
        ("GPL-2.0-only AND MIT OR Apache-2.0", {"gpl-2.0-only", "mit", "apache-2.0"}, True),
        ("MIT AND (GPL-3.0+ OR LGPL-2.1)", {"mit", "gpl-3.0+", "lgpl-2.1"}, False),
        ("Apache-2.0 WITH LLVM-exception */", {"apache-2.0-with-llvm-exception"}, True),
        ("(MIT", set(), False),
        ("AND MIT", set(), False),
    ],
)
def test_licence_expressions(expression, named, usable):
    assert licences.evaluate(licences.to_postfix(expression), frozenset(licences.PERMISSIVE)) == (named, usable)


def test_long_licence_expressions_are_read_whole():
    text = b"SPDX-License-Identifier: " + b" AND ".join([b"MIT"] * 2000) + b" AND GPL-3.0-only"
    got = licences.scan_text(text, licences.automaton(), frozenset(licences.PERMISSIVE))
    assert "gpl-3.0-only" in str(got["labels"]) and not got["permissive"]


def test_licences_of_hard_rows(spark, hard, empty):
    assert licences.scan_licences(hard).count() == len(HARD) and licences.scan_licences(empty).count() == 0
    tagged = spark.createDataFrame([(1, "/* SPDX-License-Identifier: MIT OR GPL-2.0-only */ the MIT License")], "doc_id bigint, text string")
    row = licences.scan_licences(tagged).first()
    assert (row.labels, row.permissive, row.base_labels) == ("mit,spdx:gpl-2.0-only,spdx:mit", True, "mit")


# --- chats -----------------------------------------------------------------------------


@given(st.text(alphabet="<|\\>ae\n", max_size=30))
def test_guard_is_reversible(text):
    guarded = chat.TEMPLATE.guard(text)
    assert "<|" not in guarded and chat.TEMPLATE.unguard(guarded) == text


def test_mixed_layouts_become_turns(spark):
    records = [
        '{"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}',
        '{"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": null}]}',
        '{"conv_id": 3, "prompt": "hi", "response": "yes"}',
        '{"conv_id": 4, "instruction": "do", "output": "done"}',
        '{"conv_id": 5, "unknown": 1}',
        "no json",
        None,
    ]
    got = chat.turns_of_json(spark.createDataFrame([(r,) for r in records], "record string"), "record").collect()
    turns = sorted((r.conv_id, r.turn, r.role, r.text) for r in got if r.layout)
    assert turns == [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", ""), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "do"), (4, 1, "assistant", "done")]
    assert sum(r.layout is None for r in got) == 3
    with pytest.raises(ValueError):
        chat.turns_of_columns(spark.createDataFrame([(1,)], "conv_id bigint"))


def test_rows_by_turn_keep_their_roles(spark):
    rows = spark.createDataFrame([(1, 0, "human", "hi"), (1, 1, "gpt", "yes")], "conv_id bigint, turn bigint, role string, text string")
    assert [r.role for r in chat.turns_of_columns(rows).orderBy("turn").collect()] == ["human", "gpt"]
    lines = rows.select(F.to_json(F.struct("*")).alias("record"))
    assert sorted(r.role for r in chat.turns_of_json(lines, "record").collect()) == ["gpt", "human"]
    read = chat.read_back(chat.format_turns(chat.turns_of_columns(rows))).first()
    assert read.turns_sha256 == hashlib.sha256(b"human\nhi\ngpt\nyes\n").hexdigest() and read.loss_chars == 0


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "<|end|> \\ <|"), (1, 0, "user", None), (1, 1, "assistant", "<|end|> \\ <|"), (2, 0, None, ""), (None, None, "assistant", "x"), (3, 0, "assistant", "é" * 50_000)]
    turns = chat.turns_of_columns(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, piece int"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    said = "<|end|> \\ <|"
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((said * 2).encode()).hexdigest() and got[1].loss_chars == 2 * len(said)
    assert (got[2].n_turns, got[None].n_turns, got[3].loss_chars) == (1, 1, 50_000)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    first = brute_components({r.doc_id: brute_fingerprint(r.text) for r in kept})
    kept = [r for r in kept if first[r.doc_id] == r.doc_id]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for r in kept:
        n, hit, _ = brute_contamination(r.text, bench) if len(r.text) < 6000 else (1, 0, ())
        if not (hit and 20 * hit >= n):
            want[r.doc_id] = zlib.crc32(np.array(model.encode(pii.masked_text(r.text)), "<u4").tobytes())
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and all(r.round_trip for r in got)


def test_stages_handle_hard_rows(spark, hard, empty):
    for docs in (hard, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
