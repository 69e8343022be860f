"""Personal data, and the terms that give it away.

Patterns find e-mail and IP addresses, card and phone numbers. From the documents that hold both the corpus tells how strongly a term
reveals such an entity: disclosure is the share of the entity's information content that the term's pointwise mutual
information with it covers, 1 - log p(entity | term) / log p(entity). Terms above a threshold are reported in the
documents of that entity and generalised in the sanitised text, or removed where the term gives the entity away entirely.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, maybe_in, membership_map, prepare, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Least disclosure of a reported term, and from where on it is removed instead of generalised.
DISCLOSURE, REMOVAL = 0.85, 0.98

#: Different texts in which term and entity must meet.
MEETINGS = 2

# The patterns of the kinds. An address is anchored at its sign so that long words cost no more.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")

# Marks that enclose words, and runs of them at a word's end or start.
MARKS = ".,;:!?\"'`()[]{}<>*_«»“”„‘’…"
_M, _S = re.escape(MARKS), r"\x20\x09-\x0D"
_ENCLOSING = re.compile(rf"(?<![^{_S}])[{_M}]+|(?<![{_M}])[{_M}]+(?![^{_S}])")

#: Pairs in one batch of output.
PAIR_ROWS = 200_000

#: What stands for a found span in sanitised text.
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        sign = text.find("@", max(free, sign + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_octet(part: str) -> bool:
    """At most 255, with any number of leading zeros."""
    value = part.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and int(value) <= 255)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then place; matches of one kind do not overlap."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_is_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(_DIGITS.findall(m.group()))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


def canonical(kind: str, value: str) -> str:
    """One form for the spellings of an entity."""
    return value.lower() if kind == "email" else "".join(re.findall(r"[0-9.]" if kind == "ip" else r"[0-9]", value))


def term_of(word: str) -> str:
    """A word as the corpus counts it: A-Z lowered, without enclosing marks."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word.strip(MARKS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def entity_of(kind: str, value: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{kind}:{canonical(kind, value)}".encode("utf-8", "surrogatepass")))


def body_of(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def terms_in(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes and places of all words of a text, without their enclosing marks and without words of spans."""
    covered = np.zeros(len(text) + 1, dtype=np.int64)
    for _, a, b in spans:
        covered[a] += 1
        covered[b] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
    words, places = [], []
    for m in _WORD.finditer(text):
        if covered[m.end()] == covered[m.start()]:
            word = m.group()
            start = m.start() + len(word) - len(word.lstrip(MARKS))
            word = word.strip(MARKS)
            if word:
                words.append(word)
                places.append((start, start + len(word)))
    return hash_words(words)[0].view(np.int64), places


_SPAN = "array<struct<kind:string,start:int,end:int>>"
_BASE = f"uid long, doc_id string, spans {_SPAN}, entities array<bigint>, body bigint"


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = base_spans(text)
            rows.append(([{"kind": k, "start": a, "end": b} for k, a, b in spans], sorted({entity_of(k, text[a:b]) for k, a, b in spans}), body_of(text) if spans else 0))
        out = pd.DataFrame(rows, columns=["spans", "entities", "body"])
        yield pd.concat([batch[["uid", "doc_id"]].reset_index(drop=True), out], axis=1)


def _holders(texts: pd.Series, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(body, copies in the batch, entities of the map, terms, places) of the different texts that hold such an entity."""
    for text, n in texts.value_counts(sort=False).items():
        spans = base_spans(text)
        entities = np.array(sorted({entity_of(k, text[a:b]) for k, a, b in spans}), dtype=np.int64)
        if len(entities):
            entities = entities[maybe_in(bits, entities)]
        if len(entities):
            yield body_of(text), n, entities, *terms_in(text, spans)


def _terms(entities: Broadcast):
    """Terms of the documents that hold an entity of the map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x[3] for x in _holders(batch["text"], entities.value)]
            yield pd.DataFrame({"term": np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)})

    return run


def _pairs(entities: Broadcast, terms: Broadcast):
    """(entity, term, body, documents) of entities and terms of the maps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body, n, held, words, _ in _holders(batch["text"], entities.value):
                words = np.unique(words)
                words = words[maybe_in(terms.value, words)]
                step = max(1, PAIR_ROWS // max(1, len(words)))
                for k in range(0, len(held) if len(words) else 0, step):
                    part = held[k : k + step]
                    yield pd.DataFrame({"entity": np.repeat(part, len(words)), "term": np.tile(words, len(part)), "body": body, "n": n})

    return run


def _places(entities: Broadcast, pairs: Broadcast):
    """(body, entity, term, start, end) of every occurrence of a term in a text that holds the entity, by the map of pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body, _, held, words, places in _holders(batch["text"], entities.value):
                spots = np.array(places, dtype=np.int64).reshape(-1, 2)
                for entity in held:
                    at = np.flatnonzero(maybe_in(pairs.value, words ^ entity))
                    if len(at):
                        yield pd.DataFrame({"body": body, "entity": entity, "term": words[at], "start": spots[at, 0], "end": spots[at, 1]})

    return run


def _document_frequencies(terms: Broadcast):
    """Documents that hold a term of the map, combined per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = terms.value
        for batch in batches:
            words, at = hash_words([_ENCLOSING.sub(" ", t) for t in batch["text"]])
            maybe = maybe_in(bits, words)
            some = words[maybe]
            owner = np.repeat(np.arange(len(batch)), np.diff(at))[maybe]
            order = np.lexsort((owner, some))
            some, owner = some[order], owner[order]
            fresh = np.ones(len(some), dtype=bool)
            fresh[1:] = (some[1:] != some[:-1]) | (owner[1:] != owner[:-1])
            found, n = np.unique(some[fresh], return_counts=True)
            yield pd.DataFrame({"term": found.view(np.int64), "n": n})

    return run


def shared_entities(found: DataFrame, documents: int) -> DataFrame:
    """(entity, held) of those in at least two different texts; no other one can meet a term in two of them."""
    bodies = found.select("body", F.explode("entities").alias("entity")).groupBy("entity", "body").agg(F.count(F.lit(1)).alias("n"))
    held = bodies.groupBy("entity").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("bodies"))
    return stored(held.where((F.col("bodies") >= MEETINGS) & (F.col("held") < documents)).select("entity", "held"), "private")


def disclosing_terms(held: DataFrame, entities: Broadcast, texts: DataFrame, documents: int, disclosure: float) -> DataFrame:
    """(entity, term, disclosure) above the threshold, from whole documents.

    Joint counts are of different texts, so that copies do not make a term telling. Terms of documents with shared
    entities are counted in the corpus first: one in more documents than the threshold allows for the most frequent
    entity, or in one only, makes no pairs. Fixed-size bit maps pick terms in the scans, and joins count them exactly.
    """
    spark = texts.sparkSession
    terms = texts.mapInPandas(_terms(entities), "term long").distinct()
    bits = spark.sparkContext.broadcast(membership_map(terms, "term"))
    most = held.agg(F.max("held")).first()[0] or 1
    # both / df >= (held / documents) ** (1 - disclosure), and both <= held
    limit = most * (max(documents, 2) / most) ** (1 - disclosure) + 1
    counted = texts.mapInPandas(_document_frequencies(bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    counted = stored(counted.where(F.col("df").between(MEETINGS, limit)), "private")
    rare = spark.sparkContext.broadcast(membership_map(counted, "term"))
    pairs = texts.mapInPandas(_pairs(entities, rare), "entity long, term long, body long, n long").groupBy("entity", "term", "body").agg(F.sum("n").alias("n"))
    together = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= MEETINGS)
    ratio = 1 - F.log(F.col("both") / F.greatest("df", "both")) / F.log(F.col("held") / F.lit(float(max(documents, 2))))
    return together.join(held, "entity").join(counted, "term").select("entity", "term", ratio.alias("disclosure")).where(F.col("disclosure") >= disclosure)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, base (spans by kind, then place) and terms (start, end, disclosure); text if asked.

    A null text is empty and has no spans. Terms are all words, without enclosing marks, of a document with an entity whose disclosure of it
    reaches the threshold, wherever they stand; a term that several entities share counts with the highest one. Repeated rows are documents of
    their own, but equal texts count once when term and entity are paired. Null ids and further columns do no harm; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    if keep_text:
        rows = stored(rows, "texts")
    table = stored(rows.mapInPandas(_detect, _BASE), "private")
    found = table.where(F.size("spans") > 0)
    documents, texts = table.count(), rows.select("text")
    held = shared_entities(found, documents)
    entities = spark.sparkContext.broadcast(membership_map(held, "entity"))
    terms = stored(disclosing_terms(held, entities, texts, documents, disclosure), "private")
    pairs = spark.sparkContext.broadcast(membership_map(terms.select(F.col("entity").bitwiseXOR(F.col("term")).alias("pair")), "pair"))
    told = (
        texts.mapInPandas(_places(entities, pairs), "body long, entity long, term long, start int, end int").join(terms, ["entity", "term"])
        .groupBy("body", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("body").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    )
    told = found.select("uid", "body").join(told, "body").select("uid", "terms")
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    out = table.join(told, "uid", "left").select("uid", F.col("doc_id").cast(kind).alias("doc_id"), F.col("spans").alias("base"), F.coalesce("terms", none).alias("terms"))
    return out.join(rows.select("uid", "text"), "uid").drop("uid") if keep_text else out.drop("uid")


def sanitised(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int, float]]) -> str:
    """Text with entities and terms replaced; a term that is all of a disclosure goes. Overlaps: the first, longest span."""
    spans = [(a, -b, PLACEHOLDERS[k]) for k, a, b in base]
    spans += [(a, -b, "" if d >= REMOVAL else PLACEHOLDERS[TERM]) for a, b, d in terms]
    out, at = [], 0
    for a, b, instead in sorted(spans):
        if a >= at:
            out += [text[at:a], instead]
            at = -b
        elif -b > at:
            at = -b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text (sanitised), base and terms of every document."""
    found = find_private(docs, id_col, text_col, disclosure, keep_text=True)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([
            sanitised(t, [(x["kind"], x["start"], x["end"]) for x in b], [(x["start"], x["end"], x["disclosure"]) for x in d])
            for t, b, d in zip(texts, base, terms)
        ], dtype=object)

    return found.withColumn("text", clean("text", "base", "terms"))


def digest(column: str, kind: str | None = None):
    """kind:start:end of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"] if kind is None else F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))))
