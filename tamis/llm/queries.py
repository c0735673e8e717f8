"""The registered queries of this package, with SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import chat, decontaminate, filter_audit, hyperminhash, importance, langid, licences, neighbours, pieces, pii, sharding, simhash, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query()
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    found = pii.find_personal_data(_table(spark, folder, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))
    kinds = F.transform(plain, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    return found.select("doc_id", *((F.size(kinds) - n).cast("bigint").alias(f"n_{k}") for k, n in zip(pii.KINDS, counts)), F.sha2(text(plain), 256).alias("base_sha256"), text("spans").alias("spans"))


@_query()
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query()
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, with the proof that they decode to it."""
    return pieces.encode_proved(_table(spark, folder, "documents"))


@_query()
def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    docs = _table(spark, folder, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return sharding.shard_by_bytes(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# Words of both tables; windows of 13 words (or the whole item) joined by blanks; every word
# of a document that lies inside a place of a window.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query(
    f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item, len(w[s:s + least(13, len(w)) - 1]) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n)),
places AS (SELECT DISTINCT doc_id, s, dw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM places) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM places) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""
)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query()
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return token_files.round_trip(_table(spark, folder, "documents"), public_tokenizers.path(token_files.VOCABULARY))


def held_out() -> Column:
    """Whether a document belongs to the third that nothing is learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


@_query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.filter(~held_out()))
    return langid.classify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query(
    """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])),
                          lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10"""
)
def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of all vectors for every hundredth."""
    vectors = _table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@_query()
def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and tags of every document."""
    return licences.scan_licences(_table(spark, folder, "documents"))


# What the template adds to a turn, and its escapes.
_MARKS = len(chat.TEMPLATE.start + chat.TEMPLATE.middle + chat.TEMPLATE.end)
_GUARDED = "2 * length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '<|', ''))) // 2"


@_query(
    f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_MARKS} + {_GUARDED.format('role')} + {_GUARDED.format('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
)
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    # its layout differs from the table's, so its fingerprint selects another mapping
    own = spark.sql(f"SELECT -7L AS conv_id, array(named_struct('role', 'user', 'content', '{said}'), named_struct('role', 'assistant', 'content', '{said}')) AS messages")
    turns = chat.turns_of_columns(_table(spark, folder, "conversations")).unionByName(chat.turns_of_columns(own))
    return chat.read_back(chat.format_turns(turns))


@_query(
    """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (
  WITH RECURSIVE r(node, c) AS (
    SELECT doc_id, doc_id FROM d
    UNION SELECT l.v, r.c FROM r JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) l ON r.node = l.u)
  SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON d.doc_id = reach.node"""
)
def op11_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and component of every document, links confirmed on whole shingle sets."""
    return hyperminhash.near_duplicates(_table(spark, folder, "documents"))


@_query(
    f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bucket AS (
  SELECT word, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM vocabulary CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN bucket USING (word) GROUP BY bucket),
gain AS (
  SELECT i AS bucket, floor(1000 * ln(
    (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
weights AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS weight
  FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed"""
)
def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the rank of the drawn tenth."""
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query(
    """
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::BIGINT AS before
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS i FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes in every order, per language."""
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
