"""Registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_documents
from .codes import compress_vectors
from .contamination import contamination_report
from .language import identify_languages
from .licences import find_licences
from .maxent import language_model_scores
from .packing import pack_documents
from .privacy import KINDS, TERM, digest, find_private
from .quality import score_quality
from .setsketch import near_duplicates
from .templates import LONG_DOCS, drop_recurring_lines
from .trie import prefix_trie
from .vectors import near_vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words between white space, A-Z lowered, with their places; the first step of several checks.
_WORDS = r"""
words AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, w
  FROM (
    SELECT doc_id, generate_subscripts(ws, 1) AS k, unnest(ws) AS w
    FROM (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS ws FROM documents)
  ) WHERE w <> ''
)"""


@query(
    "op6_setsketch_near_dedup",
    sql=f"""
WITH RECURSIVE {_WORDS},
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS s, count(*) OVER (PARTITION BY doc_id) AS n, w FROM words
  ) t WHERE s IS NOT NULL
  UNION
  SELECT doc_id, min(w) FROM words GROUP BY doc_id HAVING count(*) = 1
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""",
)
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on two-word shingles at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query(
    "op4_contamination",
    sql=r"""
WITH
low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
),
split AS (SELECT kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM low),
benchmark_windows AS (
  SELECT DISTINCT id AS item_id, len(ws) AS n, list_slice(ws, i, i + 12) AS win
  FROM (SELECT id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM split WHERE kind = 'b' AND len(ws) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS k FROM benchmark_windows),
document_windows AS (
  SELECT id AS doc_id, i, k, list_slice(ws, i, i + k - 1) AS win
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, sizes WHERE kind = 'd' AND len(ws) >= k)
),
hits AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM document_windows d JOIN benchmark_windows b ON d.win = b.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS all_items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
)
SELECT s.id AS doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(s.ws) AS contaminated
FROM split s LEFT JOIN covered c ON c.doc_id = s.id LEFT JOIN items i ON i.doc_id = s.id WHERE s.kind = 'd'
""",
)
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding passages of benchmark items."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("chars")


@query("op3_best_fit_packing")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op10_line_templates")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.col("before").isNull(), 0).otherwise(F.size(F.split("before", "\n", -1)))
    return drop_recurring_lines(docs.withColumn("before", F.col("text")), long_docs=LONG_DOCS).select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.size("dropped_lines").cast("long").alias("n_dropped"),
        F.concat_ws(",", F.col("dropped_lines").cast("array<string>")).alias("dropped"), "text",
    )


@query("op8_kernel_language")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    found = identify_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language.held_out", "language.lang_pred", "language.score")


@query(
    "op2_subspace_vectors",
    sql="""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(max(n), 0) AS n_links, min(other) AS component_id, e.vec_id = min(other) AS kept
FROM embeddings e JOIN reach r ON r.vec_id = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id GROUP BY e.vec_id
""",
)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of at least 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_maxent_scores")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return language_model_scores(table(spark, sf_dir, "documents"))


@query("op7_factorisation_quality")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=["n_chars"])
    return found.select("doc_id", "quality.held_out", "quality.score", "quality.predicted")


@query("op1_licence_scan")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    found = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = F.transform("licences", lambda x: F.concat_ws(":", x["template"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_passages"), F.array_join(F.array_sort(F.array_distinct("licences.template")), ",").alias("licences"),
        F.round(F.array_max("licences.dice"), 6).alias("best_dice"), F.array_join(hits, ",").alias("passages"),
    )


@query("op5_disclosure_control")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that reveal it."""
    found = find_private(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base, terms = digest("base"), digest("terms", TERM)
    return found.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(base, terms), lambda s: s != ""), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


@query("op11_chunked_bpe")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to."""
    found = decode_ids(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


_PARTS, _ENTRIES, _ROUNDS = 4, 256, 4


def _lloyd_sql() -> str:
    """Plain rounds that compare every part with every entry."""
    rounds = []
    for k in range(_ROUNDS + 1):
        rounds.append(f"""
codes_{k} AS (
  SELECT vec_id, part, x, d, entry FROM (
    SELECT p.vec_id, p.part, p.x, e.entry, list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
           row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY d, e.entry) AS place
    FROM parts p JOIN books_{k} e ON e.part = p.part
  ) WHERE place = 1
)""")
        if k < _ROUNDS:
            rounds.append(f"""
means_{k} AS (
  SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
    SELECT part, entry, i, sum(x[i])::BIGINT AS total, count(*) AS n FROM codes_{k}, range(1, (SELECT any_value(len(x)) + 1 FROM parts)) t(i) GROUP BY ALL
  ) GROUP BY part, entry
),
books_{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books_{k} b LEFT JOIN means_{k} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
),
parts AS (SELECT vec_id, part, list_slice(q, part * len(q) // {_PARTS} + 1, (part + 1) * len(q) // {_PARTS}) AS x FROM kept, range({_PARTS}) t(part)),
books_0 AS (SELECT p.part, f.entry, p.x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) f JOIN parts p ON p.vec_id = f.vec_id WHERE entry < {_ENTRIES}),
{",".join(rounds)},
errors AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM codes_{_ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books_{_ROUNDS})
SELECT e.vec_id, e.code, e.error, sum(e.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256
FROM errors e JOIN kept k ON k.vec_id = e.vec_id, books
"""


@query("op12_active_lloyd", sql=_lloyd_sql())
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four rounds over four codebooks of 256 entries."""
    found = compress_vectors(table(spark, sf_dir, "embeddings"), parts=_PARTS, entries=_ENTRIES, rounds=_ROUNDS)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


@query(
    "op13_prefix_trie",
    sql=r"""
WITH ids AS (
  SELECT conv_id, CAST(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v // 2, 3988292384 * (v % 2)))
  ) AS BIGINT) AS state
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
),
heads AS (SELECT conv_id, xor(state, 4294967295) % 4 AS h FROM ids),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
rebuilt AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(o.turns, h + 1, len(o.turns))) AS turns
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
),
prefixes AS (SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS prefix, len(turns) AS length FROM rebuilt, range(0, (SELECT max(len(turns)) + 1 FROM rebuilt)) t(d) WHERE d <= len(turns)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, prefix
),
members AS (SELECT p.conv_id AS member, n.* FROM prefixes p JOIN nodes n ON n.depth = p.depth AND n.prefix = p.prefix),
linked AS (
  SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.ends_sha256,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(list_filter(regexp_split_to_array(n.prefix[-1].text, '[ 	-]+'), lambda w: w <> '')) END AS saved
  FROM nodes n LEFT JOIN members p ON p.member = n.conv_id AND p.depth = n.depth - 1
),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
totals AS (
  SELECT above.conv_id, above.depth, sum(x.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM linked x JOIN members above ON above.member = x.conv_id AND above.depth <= x.depth
  LEFT JOIN children k ON k.conv_id = x.conv_id AND k.depth = x.depth
  GROUP BY above.conv_id, above.depth
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked l JOIN totals t ON t.conv_id = l.conv_id AND t.depth = l.depth LEFT JOIN children k ON k.conv_id = l.conv_id AND k.depth = l.depth
""",
)
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
