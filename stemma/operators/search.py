"""Lexical, vector and fused search. Scores lie in 0..1, higher is better, in every tier."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from ..plans.checkpoints import cut

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
DIMENSIONS = 256


def _accented() -> tuple[str, str]:
    """Letters with marks, and the letters they fold to, by canonical decomposition of the Latin, Greek and Cyrillic blocks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for lo, hi in ((0xC0, 0x600), (0x1E00, 0x2000)) for c in range(lo, hi) if chr(c).isalpha()]
    kept = [(c, base) for c, base in pairs if base != c]
    return "".join(c for c, _ in kept), "".join(base for _, base in kept)


_MARKED, _BARE = _accented()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, _MARKED, _BARE))


def tokens(text: Column) -> Column:
    """Letters and digits, folded; everything else parts tokens."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(query: str) -> list[list[str]]:
    """What a query asks for: its words, each a phrase of the tokens it holds (``a_b`` is "a b")."""
    folded = query.translate(str.maketrans(_MARKED, _BARE)).lower()
    words = [re.findall(r"[^\W_]+", w) for w in re.findall(r"\w+", folded)]
    return [list(p) for p in sorted({tuple(w) for w in words if w})]


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, dl (tokens of the row), term, tf (see ``text_index`` for a kept index)."""
    t = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t")).select("key", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))


def _weight(tf: Column, n: Column, df: Column, dl: Column, avg_dl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))).otherwise(0.0)


def _occurrences(array: str, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(array, lambda x: x == phrase[0]))
    starts = F.sequence(F.lit(0), F.size(array) - len(phrase))

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(array, i + k) == w for k, w in enumerate(phrase)])

    return F.when(F.size(array) >= len(phrase), F.size(F.filter(starts, here))).otherwise(0)


def bm25(docs: DataFrame, key: str, text: str | list[str], query: str) -> DataFrame:
    """key, score over all rows of ``docs``: r / (1 + r) of the BM25 sum r.

    A text is cut into tokens once; what is kept of a row is its length and the query's counts.
    Several columns count as one text, but no phrase runs from one into the next.
    """
    phrases = query_phrases(query)
    spark = docs.sparkSession
    if not phrases:
        return spark.createDataFrame([], "key string, score double")
    columns = [text] if isinstance(text, str) else text
    t = docs.select(F.col(key).alias("key"), *[tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])
    every = range(len(columns))
    counts = [reduce(lambda a, b: a + b, [_occurrences(f"t{i}", p) for i in every]).alias(f"f{k}") for k, p in enumerate(phrases)]
    f = cut(t.select("key", reduce(lambda a, b: a + b, [F.size(f"t{i}") for i in every]).alias("dl"), *counts))
    stats = f.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(phrases))])
    scored = f.where(" OR ".join(f"f{k} > 0" for k in range(len(phrases)))).crossJoin(F.broadcast(stats))  # one row
    raw = reduce(lambda a, b: a + b, [_weight(F.col(f"f{k}"), F.col("n"), F.col(f"n{k}"), F.col("dl"), F.col("avg_dl")) for k in range(len(phrases))])
    return scored.select("key", F.greatest(raw, F.lit(0.0)).alias("r")).select("key", (F.col("r") / (1 + F.col("r"))).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "key", score: str = "score") -> DataFrame:
    """The k best with their rank; ties by key."""
    page = scored.orderBy(F.desc(score), key).limit(k)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # over k rows


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def vector_search(rows: DataFrame, key: str, vector: str, query: list[float], model: str | None = None) -> DataFrame:
    """key, score = (cosine + 1) / 2 against rows of the same model."""
    rows = rows.where(F.col("embedding_model") == model) if model is not None else rows
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), ((cosine(F.col(vector), q) + 1) / 2).alias("score"))


#: ``SPLITS`` blocks share a group where each then has over ``SHARED`` rows; a task's matrices have up to ``CELLS`` rows and columns.
SPLITS, SHARED, CELLS = 6, 512, 2048


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Nearest:
    """The k best cosines that n rows have met, ties (to 12 places, so that copies tie wherever they lie) to the lower place."""

    def __init__(self, n: int, k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.cos, self.place = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, places: np.ndarray, codes: tuple[np.ndarray, np.ndarray]) -> None:
        """``rows`` of ``x`` meet ``places`` of ``y``; ``codes`` number the keys of both, and a key never meets itself."""
        for r in (rows[i : i + CELLS] for i in range(0, len(rows), CELLS)):
            for p in (places[i : i + CELLS] for i in range(0, len(places), CELLS)):
                c = x[r] @ y[p].T
                c[codes[0][r, None] == codes[1][None, p]] = -np.inf
                top = c.max(1)
                better = (top >= self.threshold - 1e-9) & (top >= self.cos[r].min(1) - 1e-11)
                if better.any():
                    self._take(r[better], c[better], p)

    def _take(self, r: np.ndarray, c: np.ndarray, p: np.ndarray) -> None:
        k = self.k
        c, p = np.hstack([self.cos[r], c]), np.hstack([self.place[r], np.broadcast_to(p, c.shape)])
        best = np.argpartition(-c, k - 1, axis=1)[:, :k]
        tied = (c >= np.take_along_axis(c, best, 1).min(1, keepdims=True) - 1e-11).sum(1) > k
        best[tied] = np.lexsort((p[tied], -np.round(c[tied], 12)), axis=1)[:, :k]
        self.cos[r], self.place[r] = np.round(np.take_along_axis(c, best, 1), 12), np.take_along_axis(p, best, 1)

    def frame(self, keys: np.ndarray, others: np.ndarray) -> pd.DataFrame:
        """key, other, cos of what reaches the threshold."""
        at, slot = np.nonzero(np.isfinite(self.cos) & (self.cos >= self.threshold))
        return pd.DataFrame({"key": keys[at], "other": others[self.place[at, slot]], "cos": self.cos[at, slot]})


def number_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    return codes[: len(a)], codes[len(a) :]


def nearest_in_blocks(k: int, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The k nearest, by cosine, that the rows of two blocks (sides 0 and 1) have in each other; side 0 alone: within itself."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[pdf["side"] == s].sort_values("key") for s in (0, 1)]
        sides = [(p["key"].to_numpy(), unit_rows(p["v"])) for p in parts if len(p)]
        out = []
        for (keys, x), (others, y) in zip(sides, sides[::-1]):
            found = Nearest(len(x), k, threshold)
            found.meet(x, np.arange(len(x)), y, np.arange(len(y)), number_keys(keys, others))
            out.append(found.frame(keys, others))
        return pd.concat(out)

    def checked(pdf: pd.DataFrame) -> pd.DataFrame:
        one_block = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        alone = not one_block and pdf["side"].nunique() < 2
        return near(pdf) if not alone else pd.DataFrame({"key": pdf["key"][:0], "other": pdf["key"][:0], "cos": np.zeros(0)})

    return checked


def knn_pairs(rows: DataFrame, key: str, vector: str, group: str, k: int = 5, threshold: float = 0.9, block: int = 65_536) -> DataFrame:
    """Pairs a < b within a group whose cosine reaches the threshold and where one is among the other's k nearest.

    A group is cut into blocks by key hash and every two of them meet in one task, so no task holds a
    whole group; each task keeps only k neighbours a row. ``SPLITS`` blocks share a group, more only
    where one would have over ``block`` rows, so a row goes to few tasks however large its group is.
    """
    known = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(group).alias("g"))
    sized = known.groupBy("g").agg(F.count("*").alias("n")).select("g", in_pieces(F.col("n"), block).alias("blocks"))
    r = known.join(sized, "g").withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = r.select("g", "blk", "key", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("far"))
    dealt = met.select("g", F.least("blk", "far").alias("i"), F.greatest("blk", "far").alias("j"), "key", "v", (F.col("blk") > F.col("far")).cast("int").alias("side"))

    kind = dict(rows.dtypes)[key]
    found = spread(dealt, "g", "i", "j").groupBy("g", "i", "j").applyInPandas(nearest_in_blocks(k, threshold), f"key {kind}, other {kind}, cos double")
    return mutual_pairs(found, k, threshold)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by all of ``keys``, tasks not merged by their bytes: their work grows with the square of these."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_pieces(n: Column, block: int) -> Column:
    """Into how many pieces ``n`` rows are cut: ``SPLITS`` at most, but more where one would have over ``block`` rows."""
    return F.greatest(F.ceil(n / block), F.least(F.lit(SPLITS), F.ceil(n / SHARED))).cast("int")


def mutual_pairs(found: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs a < b of (key, other, cos) rows where one is among the other's k best and the cosine reaches the threshold."""
    w = Window.partitionBy("key").orderBy(F.desc("cos"), "other")
    best = found.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("cos") >= threshold))
    return best.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cosine"))


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """key, score of ranked lists (key, rank from 1), scaled so that first in all non-empty lists is 1."""
    tagged = None
    for i, ranked in enumerate(lists):
        one = ranked.select("key", F.lit(i).alias("list"), (1.0 / (k + F.col("rank"))).alias("s"))
        tagged = one if tagged is None else tagged.unionByName(one)
    full = tagged.agg(F.count_distinct("list").alias("lists"))
    return tagged.groupBy("key").agg(F.sum("s").alias("s")).crossJoin(F.broadcast(full)).select("key", (F.col("s") / (F.col("lists") / F.lit(float(k + 1)))).alias("score"))  # one row


def hybrid_search(docs: DataFrame, key: str, text: str, query: str, vectors: DataFrame, vector_key: str, vector: str, query_vector: list[float], k: int = 10, min_score: float = 0.0, extra_queries: list[str] | None = None, lexical: Callable[[str, int], DataFrame] | None = None) -> DataFrame:
    """Lexical and vector ranks fused; ``lexical(query, n)`` (an index's ``search``, say) replaces the scan of ``docs``."""
    lexical = lexical or (lambda q, n: top_k(bm25(docs, key, text, q), n))
    legs = [lexical(q, 2 * k) for q in [query, *(extra_queries or [])]]
    legs.append(top_k(vector_search(vectors, vector_key, vector, query_vector), 2 * k))
    return top_k(rrf(legs).where(F.col("score") >= min_score), k)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def name_search(nodes: DataFrame, query: Column | str, limit: int = 8, include_proposed: bool = True) -> DataFrame:
    """Exact, then prefix, then contained keys; shorter names first."""
    from ..functions.text import normalize_name
    from .graph import visible

    q = normalize_name(F.lit(query) if isinstance(query, str) else query)
    n = F.col("normalized_name")
    bucket = F.when(n == q, 0).when(n.startswith(q), 1).when(F.contains(n, q), 2)
    hits = visible(nodes, include_proposed).withColumn("bucket", bucket).where((q != "") & F.col("bucket").isNotNull())
    return hits.orderBy("bucket", F.length("name"), "name", "id").limit(limit)


def entity_lookup(nodes: DataFrame, aliases: DataFrame, name: str, include_proposed: bool = False, entity_type: str | None = None, limit: int = 5, fuzzy: bool = False, lexical: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """id, tier, score: normalized name (1.0), alias (0.95), then lexical matches; an id's first tier wins.

    Lexical matches are of name, aliases and properties, as far as ``nodes`` has these columns.
    ``lexical(query)`` gives (key, score) over all rows in another way, such as ``TextIndex.scores``.
    """
    from ..functions.text import normalize_name
    from .graph import visible

    q = normalize_name(F.lit(name))
    seen = visible(nodes, include_proposed)
    seen = seen.where(F.col("entity_type") == entity_type) if entity_type else seen
    hits = seen.where(F.col("normalized_name") == q).select("id", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    by_alias = aliases.where(F.col("normalized_alias") == q).select(F.col("node_id").alias("id")).distinct()
    hits = hits.unionByName(seen.join(by_alias, "id", "left_semi").select("id", F.lit(2).alias("tier"), F.lit(0.95).alias("score")))
    if fuzzy:
        whole = {"aliases", "properties"} <= set(nodes.columns)
        scored = lexical(name) if lexical else bm25(nodes.withColumn("_body", node_text(nodes) if whole else F.col("name")), "id", "_body", name)
        found = scored.join(seen.select(F.col("id").alias("key")), "key", "left_semi")
        hits = hits.unionByName(top_k(found, limit).select(F.col("key").alias("id"), F.lit(3).alias("tier"), "score"))
    first = hits.groupBy("id").agg(F.min(F.struct("tier", "score")).alias("b")).select("id", "b.tier", "b.score")
    return first.orderBy("tier", F.desc("score"), "id").limit(limit)


def hash_vector(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed hashed counts of padded character 3-grams and words, to unit length."""
    words = (text or "").casefold().split()
    padded = f" {' '.join(words)} "
    v = np.zeros(dimensions)
    for f in [padded[i : i + 3] for i in range(len(padded) - 2)] + words:
        h = hashlib.md5(f.encode()).digest()
        v[int.from_bytes(h[:4], "little") % dimensions] += 1 if h[4] % 2 == 0 else -1
    norm = math.sqrt(float(v @ v))
    return (v / norm if norm else v).astype(np.float32).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(hash_vector)


def node_text(nodes: DataFrame) -> Column:
    """What a node's embedding is made from: name, aliases, properties, each parted by a bar."""
    said = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(said, F.array().cast("array<string>"))), " | ")


def embed_missing(nodes: DataFrame, embed, model: str) -> tuple[DataFrame, DataFrame]:
    """(nodes whose visible rows all carry ``model``'s embedding; one row: embedded, skipped).

    ``embed`` is a column function of text (such as ``hash_embedding``). Only rows without an
    embedding of this model are embedded, rejected ones never.
    """
    live = F.col("status").isin("proposed", "verified")
    stale = live & (F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))
    stats = nodes.agg(F.count_if(stale).alias("embedded"), F.count_if(~stale & F.col("embedding_model").eqNullSafe(F.lit(model))).alias("skipped"))
    fresh = nodes.where(stale).withColumn("embedding", embed(node_text(nodes))).withColumn("embedding_model", F.lit(model))
    return nodes.where(~stale | stale.isNull()).unionByName(fresh), stats


def pack_vector(vector: Column) -> Column:
    """Little-endian 32-bit floats."""
    return _packed(vector)


def unpack_vector(blob: Column) -> Column:
    return _unpacked(blob)


@F.pandas_udf(BinaryType())
def _packed(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def _unpacked(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in blobs:
        yield s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist())


def citing_documents(items: DataFrame, citations: DataFrame, kind: str = "node") -> DataFrame:
    """``items`` with ``source_documents``: the sorted distinct documents that cite each, else its own."""
    cited = citations.where(F.col("kind") == kind).groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_set("doc_id")).alias("cited"))
    own = F.array("source_doc")
    return items.join(cited, "id", "left").withColumn("source_documents", F.when(F.size(F.coalesce("cited", F.array().cast(f"array<{dict(citations.dtypes)['doc_id']}>"))) > 0, F.col("cited")).otherwise(own)).drop("cited")


def expand_query(query: str, limit: int = 8, width: int = 50) -> list[str]:
    """Rule-made variants: lower case, joined, split CamelCase; never the query itself."""
    import re

    parts = query.split()
    made = [query.lower(), "".join(parts), " ".join(re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", query))]
    out, seen = [], {query.casefold()}
    for m in (x.strip() for x in made):
        if m and len(m) <= width and m.casefold() not in seen:
            seen.add(m.casefold())
            out.append(m)
    return out[:limit]
