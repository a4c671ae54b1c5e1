"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items and documents are lower-cased (A-Z only) and cut into words of ASCII digits, letters and any
non-ASCII characters. The automaton holds every word sequence that occurs inside an item. A
document streams through it; the automaton keeps the longest item sequence that ends at each word,
and wherever that length reaches the window (``window`` words, or a whole item that is shorter) the
window's words are hit. States carry the items that contain them, so hits name their items.

Streaming is skipped only where it provably can't reach a window: a window needs as many
consecutive words that occur in some item, with every neighbouring pair of them a pair of some
item; such stretches are found on arrays, and the automaton starts afresh at each.

Items are taken in blocks of at most ``block_words`` words: one block's automaton at a time is built
on the driver, turned into flat arrays, broadcast and let go after its pass over the documents, and
the passes' hit intervals are united. So neither the driver nor a worker ever holds more than one
block, whatever the items come to.

Defined cases: null texts have no words; items without words are ignored; repeated items each
count; texts of any length stream through whole; document rows that repeat, or whose doc_id repeats
or is null, are scanned apart and kept; empty tables give empty results (no items: no hits).
``longest`` is the longest match inside the stretches that can reach a window, 0 where there is
none. Extra columns are ignored by the query; ``find_hits`` keeps them, its own columns replacing
any of the same name, and ``remove_contamination`` keeps all columns of any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _arrow_schema, alone, drop_table, persist_table, rows_to_batch, with_columns_schema

WINDOW = 10
#: Words of the items whose automaton is held at a time (about 100 bytes each once flat).
BLOCK_WORDS = 500_000
#: Bytes of words, A-Z as a-z; every other ASCII byte parts words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD_BYTE = bytes(0 if b == 32 else 1 for b in _NORMAL)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class SuffixAutomaton:
    """Of several word sequences; no sequence runs on into the next."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.items = [str(key) for key, words in items if words]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        size = len(self.next)
        #: A state's items matter where it is the window's state: link length < window <= length.
        at_window = [self.link[v] >= 0 and self.length[self.link[v]] < window <= self.length[v] for v in range(size)]
        order = sorted(range(size), key=self.length.__getitem__)
        #: The ancestor (or itself) whose strings' last `window` words are the window; 0 if none.
        self.window_state = [0] * size
        for v in order[1:]:
            self.window_state[v] = v if at_window[v] else self.window_state[self.link[v]]
        found: list[set[int]] = [set() for _ in range(size)]
        #: Whole items shorter than the window: their length and items, by their state.
        self.short: list[dict[int, list[int]] | None] = [None] * size
        for item, ids in enumerate(sequences):
            v = 0
            for w in ids:
                v = self.next[v][w]
                if self.length[v] >= window and self.window_state[v]:
                    found[self.window_state[v]].add(item)
            if len(ids) < window:
                by_length = self.short[v] = self.short[v] or {}
                by_length.setdefault(len(ids), []).append(item)
        self.window_items = [tuple(sorted(x)) for x in found]
        #: The nearest proper ancestor with a short item; 0 if none.
        self.short_link = [0] * size
        for v in order[1:]:
            up = self.link[v]
            self.short_link[v] = up if self.short[up] else self.short_link[up]
        self.least = min([min(len(s), window) for s in sequences], default=window)
        self._flatten()
        n = max(len(self.vocabulary), 1)
        self.pairs = np.unique(np.array([a * n + b for s in sequences for a, b in zip(s, s[1:])], np.int64))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _flatten(self) -> None:
        """Transitions as one sorted array of (state, word) keys and one of targets; the maps are let go."""
        width = max(len(self.vocabulary), 1)
        keys = np.fromiter((v * width + w for v, on in enumerate(self.next) for w in on), np.int64)
        targets = np.fromiter((t for on in self.next for t in on.values()), np.int32)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order]
        self.next = []
        self.link, self.length, self.window_state, self.short_link = (np.array(x, np.int32) for x in (self.link, self.length, self.window_state, self.short_link))
        self.short = {v: by for v, by in enumerate(self.short) if by}
        self.window_items = {v: items for v, items in enumerate(self.window_items) if items}

    def step(self, state: int, word: int) -> int:
        """The state after ``word``; -1 if there is none."""
        key = state * max(len(self.vocabulary), 1) + word
        at = int(np.searchsorted(self.keys, key))
        return int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal runs of item words joined by item pairs that are long enough for a window."""
        known = ids >= 0
        if len(ids) > 1 and len(self.pairs):
            pair = ids[:-1] * max(len(self.vocabulary), 1) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = known[:-1] & known[1:] & (self.pairs[at] == pair)
        else:
            joined = np.zeros(max(len(ids) - 1, 0), bool)
        edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(starts, ends):
            if b - a + 1 >= self.least:
                yield int(a), int(b) + 1
        if self.least == 1:
            single = known.copy()
            single[:-1] &= ~joined
            single[1:] &= ~joined
            for a in np.flatnonzero(single):
                yield int(a), int(a) + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word intervals (end exclusive), items whose windows occur, longest match."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        window = self.window
        for a, b in self.stretches(ids):
            state = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while (to := self.step(state, w)) < 0 and state:
                    state = int(self.link[state])
                    matched = int(self.length[state])
                if to >= 0:
                    state, matched = to, matched + 1
                longest = max(longest, matched)
                if matched >= window:
                    hits.append((i - window + 1, i + 1))
                    items.update(self.window_items.get(int(self.window_state[state]), ()))
                v = state
                while v:
                    for n, found in self.short.get(v, {}).items():
                        if n <= matched:
                            hits.append((i - n + 1, i + 1))
                            items.update(found)
                    v = int(self.short_link[v])
        return unite(hits), items, longest


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _item_blocks(items: DataFrame, window: int, block_words: int) -> tuple[int, Iterator[SuffixAutomaton]]:
    """How many blocks there are, and their automata one by one; a block's size is known before it is collected."""
    rows = items.select(F.col("item_id"), F.col("text")).where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // (2 * block_words)))  # a word and its gap take two characters at least

    def build() -> Iterator[SuffixAutomaton]:
        for k in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            texts = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
            yield SuffixAutomaton([(key, normal_words(t)) for key, t in texts], window)

    return blocks, build()


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs`` with n_words, hits (array of word intervals), item_ids (as text), longest."""
    spark = docs.sparkSession
    added = "n_words long, hits array<array<int>>, item_ids array<string>, longest int"
    names = [c for c in docs.columns if c not in ("n_words", "hits", "item_ids", "longest")]
    schema = with_columns_schema(docs, names, added)
    source = docs.select(*[F.col(f"`{c}`") for c in names])
    blocks, automata = _item_blocks(items, window, block_words)
    for k, automaton in enumerate(automata):
        shared = spark.sparkContext.broadcast(automaton)
        del automaton
        out = _scan_pass(source, shared, names.index("text"), len(names), schema, merge=k > 0)
        if blocks == 1:
            return out
        fresh = persist_table(out, "hits")
        shared.destroy()
        if k:
            drop_table(source)
        source = fresh
    return source


def _scan_pass(source: DataFrame, shared, text_at: int, width: int, schema: StructType, merge: bool) -> DataFrame:
    arrow = _arrow_schema(source.sparkSession, schema)
    added = pa.schema(list(arrow)[width:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: SuffixAutomaton = shared.value
        for batch in batches:
            old = list(zip(*(c.to_pylist() for c in batch.columns[width:]))) if merge else None
            rows = []
            for i, text in enumerate(batch.column(text_at).to_pylist()):
                words = normal_words(text)
                hits, items, longest = automaton.scan(words)
                names = {automaton.items[x] for x in items}
                if old:
                    hits = unite([*hits, *(tuple(h) for h in old[i][1])])
                    names |= set(old[i][2])
                    longest = max(longest, old[i][3])
                rows.append((len(words), hits, sorted(names), longest))
            new = rows_to_batch(rows, added)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new.columns], schema=arrow)

    return source.mapInArrow(alone(run), schema)


def word_places(text: str) -> np.ndarray:
    """(start, end) in code points of each word of ``normal_words(text)``."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(_WORD_BYTE, np.uint8)[raw]
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.stack([point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]], 1)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Cut hit spans from the texts; documents hit over more than ``max_coverage`` of their words go.

    A span is cut from its first word's start to its last word's end. Untouched documents keep
    their rows exactly; in cut ones ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest")  # so no name can clash
    hits = find_hits(docs.select(rest, "text"), items, window, block_words)
    kept = hits.where("aggregate(hits, 0L, (s, h) -> s + h[1] - h[0]) <= %r * n_words" % float(max_coverage)).select("rest", "text", "hits")
    schema = with_columns_schema(kept, ["rest", "text"], "changed boolean")
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, cut in enumerate(spans):
                if cut:
                    places, parts, at = word_places(texts[i]), [], 0
                    for a, b in cut:
                        parts.append(texts[i][at : places[a][0]])
                        at = places[b - 1][1]
                    texts[i] = "".join([*parts, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([bool(x) for x in spans])], schema=arrow)

    done = kept.mapInArrow(alone(run), schema)
    n_chars = lambda was: F.when(F.col("changed"), F.length("text").cast(was.dataType)).otherwise(F.col("rest.n_chars"))
    return done.select(*[F.col("text") if c == "text" else (n_chars(docs.schema[c]) if c == "n_chars" else F.col(f"rest.`{c}`")).alias(c) for c in names])


def op8_benchmark_decontamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    hits = find_hits(docs.select("doc_id", "text"), items, **options)
    ids = F.array_join("item_ids", ",")
    n_hit = F.expr("aggregate(hits, 0L, (s, h) -> s + h[1] - h[0])")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: DuckDB: windows as joined word strings, matched by equality.
OP8_SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), size AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM size)
), widths AS (SELECT DISTINCT n FROM win
), pos AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, widths WHERE len(w) >= n)
), hit AS (SELECT DISTINCT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win USING (n, key)
), covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
