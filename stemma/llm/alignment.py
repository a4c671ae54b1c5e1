"""Cross-tokenizer alignment by byte-owner arrays.

A text with a space before it is encoded by a byte-level tokenizer (A) and by a sentencepiece model
(B, which adds that space itself). Both token sequences spell the same bytes, so ``np.repeat`` of
token numbers over their byte lengths gives, for every byte, the A token and the B token that own
it. Where the pair of owners changes an overlap ends; where both owners change at once (and at a
text's end) both tokenizers have a boundary, a cut. Cuts part the tokens into groups, and the A and
B token that end at a cut are linked.

Two tokens that end together spell suffixes of one another, so a token has at most as many partners
as it has bytes: the table of linked id pairs is bounded by the two vocabularies (under 500,000
pairs for the default files), whatever the corpus. Tasks add their links up for themselves, Spark
sums the pairs, and the summed table is broadcast to a second pass over the stored links; texts are
encoded once.

Defined cases: null and empty texts have no tokens, nor have texts whose joined A or B bytes differ
from space + text (a text with U+2581, say): their numbers are 0, their arrays and ``groups_sha256``
empty. Special tokens' strings are plain text. Texts of any length are aligned whole, one at a time
where they are long (about 60 bytes of memory a byte of text). Rows that repeat a doc_id and null
doc_ids stay rows of their own, their links counted for each row; an empty table gives no rows; of
several A ids tied for a B id's highest count all are best. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, persist_table, rows_to_batch, trim_worker, worker_cache
from .tokens import _SAFE_CUT, PieceEncoder, default_path, slices

#: Pieces either encoder remembers, and ids that these may have in all, before it starts afresh.
CACHE_PIECES, CACHE_IDS = 400_000, 4_000_000
#: Links that a task gathers before it counts them.
PENDING = 2_000_000


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut_spaced(text: str) -> tuple[str | None, list[str]]:
    """Space + text as (head, pieces): pieces have one space before them, a head has its own white space or is None."""
    if text[:1].isspace():
        head, *pieces = _SAFE_CUT.split(" " + text)
        return head, pieces
    return None, PieceEncoder._cut(text)


class SpacedEncoder(PieceEncoder):
    """A: ids of space + text by the tokenizers library, special tokens' strings being plain text."""

    def __init__(self, path: str, max_pieces: int = CACHE_PIECES):
        super().__init__(path, max_pieces)
        self.tokenizer.encode_special_tokens = True
        self.special = []

    def token_bytes(self) -> list[bytes]:
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(alphabet[c] for c in token)
        return out

    def encode_cuts(self, cuts: list[tuple[str | None, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many ids each has)."""
        if self.count > self.max_pieces or self.ends[self.count] > CACHE_IDS:
            self._reset()
        self._learn(list({head for head, _ in cuts if head is not None}.difference(self.first)), self.first, "")
        flat = [p for _, pieces in cuts for p in pieces]
        numbers = np.fromiter(map(self.later.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(numbers < 0).tolist()
        if unknown:
            self._learn_later({flat[i] for i in unknown})
            numbers[unknown] = [self.later[flat[i]] for i in unknown]
        sizes = np.array([len(pieces) for _, pieces in cuts])
        starts = np.cumsum(sizes) - sizes
        headed = [i for i, (head, _) in enumerate(cuts) if head is not None]
        numbers = np.insert(numbers, starts[headed], [self.first[cuts[i][0]] for i in headed])
        sizes[headed] += 1
        lens, ids = self._gather(numbers)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(ends)


class PieceModelEncoder(SpacedEncoder):
    """B: ids by a sentencepiece model that puts a space before a text and joins nothing across a single one."""

    def __init__(self, path: str, max_pieces: int = CACHE_PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_pieces = max_pieces
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("this model has pieces with a space inside them; texts can't be cut at spaces")
        self._reset()

    def token_bytes(self) -> list[bytes]:
        m = self.model
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def _learn(self, names: list[str], index: dict[str, int], space: str) -> None:
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            encoded = self.model.encode(part if space else [p[1:] for p in part], num_threads=1)
            lens = np.array([len(e) for e in encoded], np.int64)
            self._append(part, index, lens, np.array([i for e in encoded for i in e], np.uint32))

    def _learn_later(self, names: set[str]) -> None:
        self._learn(list(names), self.later, " ")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters are their own bytes, 256 and up stand for the others in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteTable:
    """What each id of a vocabulary spells."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each id, the bytes of all of them)."""
        lens = self.lens[ids]
        return lens, self.flat[np.repeat(self.starts[ids] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]


def align_bytes(a_lens: np.ndarray, b_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Byte lengths of two token sequences over the same bytes -> (last A token, last B token) of each group, and
    the overlaps (A token, B token, bytes they share), in order."""
    own_a = np.repeat(np.arange(len(a_lens), dtype=np.int32), a_lens)
    own_b = np.repeat(np.arange(len(b_lens), dtype=np.int32), b_lens)
    if len(own_a) != len(own_b):
        raise ValueError("the two sequences spell texts of different lengths")
    if not len(own_a):
        none = np.zeros(0, np.int32)
        return none, none, (none, none, none)
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    last = len(own_a) - 1
    at = np.append(np.flatnonzero(new_a & new_b), last)
    over = np.append(np.flatnonzero(new_a | new_b), last)
    return own_a[at], own_b[at], (own_a[over], own_b[over], np.diff(over, prepend=-1))


@dataclass
class Aligned:
    """Some texts' tokens one after the other; ``*_ends`` have a leading 0 and then a number for each text."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    group_ends: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]

    def links(self) -> np.ndarray:
        """A id and B id of each link, in one long."""
        return self.a[self.last_a].astype(np.int64) << 32 | self.b[self.last_b].astype(np.int64)


class Aligner:
    """Both encoders with their byte tables and written ids; one for each worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = SpacedEncoder(a_path), PieceModelEncoder(b_path)
        self.a_table, self.b_table = ByteTable(self.a.token_bytes()), ByteTable(self.b.token_bytes())
        written = lambda n, end: np.array([b"%d%s" % (i, end) for i in range(n)], object)
        n_a, n_b = len(self.a_table.lens), len(self.b_table.lens)
        self.names = [written(n_a, b","), written(n_a, b"|"), written(n_b, b","), written(n_b, b";")]

    def align(self, texts: list[str]) -> Aligned:
        cuts = [cut_spaced(t) if t else (None, []) for t in texts]
        spaced = [b" " + t.encode() if t else b"" for t in texts]
        (a, n_a), (b, n_b) = self.a.encode_cuts(cuts), self.b.encode_cuts(cuts)
        raw = np.frombuffer(b"".join(spaced), np.uint8)
        (a_lens, a_bytes), (b_lens, b_bytes) = self.a_table.spell(a), self.b_table.spell(b)
        if not (np.array_equal(a_bytes, raw) and np.array_equal(b_bytes, raw)):
            good = self._spelled(n_a, a_lens, a_bytes, spaced) & self._spelled(n_b, b_lens, b_bytes, spaced)
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            a, a_lens, b, b_lens = a[keep_a], a_lens[keep_a], b[keep_b], b_lens[keep_b]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        a_ends, b_ends = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        last_a, last_b, overlaps = align_bytes(a_lens, b_lens)
        return Aligned(a, b, a_ends, b_ends, last_a, last_b, np.searchsorted(last_a, a_ends), overlaps)

    @staticmethod
    def _spelled(n: np.ndarray, lens: np.ndarray, spelled: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Which texts come out as they went in."""
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(n)])]
        return np.array([spelled[s:e].tobytes() == w for s, e, w in zip(ends[:-1], ends[1:], want)], bool)

    def written_groups(self, x: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        a_of = np.diff(x.last_a, prepend=-1)
        b_of = np.diff(x.last_b, prepend=-1)
        out = np.empty(len(x.a) + len(x.b), object)
        a_comma, a_bar, b_comma, b_semi = self.names
        part = a_comma[x.a]
        part[x.last_a] = a_bar[x.a[x.last_a]]
        out[np.arange(len(x.a)) + np.repeat(np.concatenate([[0], x.last_b + 1])[: len(a_of)], a_of)] = part
        part = b_comma[x.b]
        part[x.last_b] = b_semi[x.b[x.last_b]]
        out[np.arange(len(x.b)) + np.repeat(x.last_a + 1, b_of)] = part
        ends = (x.a_ends + x.b_ends).tolist()
        return [b"".join(out[s:e].tolist())[:-1] for s, e in zip(ends[:-1], ends[1:])]


def aligner(a_path: str, b_path: str) -> Aligner:
    cache = worker_cache("alignment")
    if (a_path, b_path) not in cache:
        cache[a_path, b_path] = Aligner(a_path, b_path)
    return cache[a_path, b_path]


def _scan(docs: DataFrame, paths: tuple[str, str], schema: str, emit: Callable[[Aligner, list, Aligned], list[tuple]], at_end: Callable[[], list[tuple]] = list) -> DataFrame:
    """Rows that ``emit`` makes of slices of documents, and ``at_end`` when a task ends."""
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        for keys, texts in slices(batches):
            yield rows_to_batch(emit(both, keys, both.align(texts)), out)
        if rows := at_end():
            yield rows_to_batch(rows, out)
        trim_worker()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The alignment itself: ids of both sides, tokens of each side in every group, and every overlap with its bytes."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def emit(_: Aligner, keys: list, x: Aligned) -> list[tuple]:
        in_a, in_b = np.diff(x.last_a, prepend=-1), np.diff(x.last_b, prepend=-1)
        over_a, over_b, shared = x.overlaps
        over_ends = np.searchsorted(over_a, x.a_ends)
        rows = []
        for i, k in enumerate(keys):
            (a0, a1), (b0, b1), g, o = x.a_ends[i : i + 2], x.b_ends[i : i + 2], slice(*x.group_ends[i : i + 2]), slice(*over_ends[i : i + 2])
            pairs = [{"a": p, "b": q, "bytes": n} for p, q, n in zip((over_a[o] - a0).tolist(), (over_b[o] - b0).tolist(), shared[o].tolist())]
            rows.append((k, x.a[a0:a1].tolist(), x.b[b0:b1].tolist(), in_a[g].tolist(), in_b[g].tolist(), pairs))
        return rows

    schema = f"doc_id {key}, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, overlaps array<struct<a:int,b:int,bytes:int>>"
    return _scan(docs, (a_path or default_path(), b_path or default_piece_path()), schema, emit)


class _LinkCounts:
    """How often each link came, counted whenever many have gathered."""

    def __init__(self) -> None:
        self.codes, self.counts, self.waiting, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, links: np.ndarray) -> None:
        self.waiting.append(links)
        self.held += len(links)
        if self.held > PENDING:
            self.settle()

    def settle(self) -> None:
        new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        self.codes, back = np.unique(np.concatenate([self.codes, new]), return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, times]), len(self.codes)).astype(np.int64)
        self.waiting, self.held = [], 0


_STORED = "kind int, doc_id {key}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _store(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Kind 0: a document's numbers and its links; kind 1: a task's link counts. The links are deflated."""
    key = docs.schema["doc_id"].dataType.simpleString()
    state: dict[str, object] = {}  # a copy for each task

    def emit(both: Aligner, keys: list, x: Aligned) -> list[tuple]:
        import zstandard

        if "counts" not in state:
            state["counts"], state["squeeze"] = _LinkCounts(), zstandard.ZstdCompressor(level=1)
        links, squeeze = x.links(), state["squeeze"]
        state["counts"].add(links)
        g = x.group_ends.tolist()
        n_a, n_b = np.diff(x.a_ends).tolist(), np.diff(x.b_ends).tolist()
        return [
            (0, k, a, b, g[i + 1] - g[i], hashlib.sha256(text).hexdigest() if text else "", squeeze.compress(_pack(links[g[i] : g[i + 1]])))
            for i, (k, a, b, text) in enumerate(zip(keys, n_a, n_b, both.written_groups(x)))
        ]

    def at_end() -> list[tuple]:
        import zstandard

        counts = state.pop("counts", None)
        if counts is None:
            return []
        counts.settle()
        blob = zstandard.ZstdCompressor(level=1).compress(counts.codes.astype("<i8").tobytes() + counts.counts.astype("<i8").tobytes())
        return [(1, None, None, None, None, None, blob)]

    return persist_table(_scan(docs, paths, _STORED.format(key=key), emit, at_end), "alignment")


def _pack(links: np.ndarray) -> bytes:
    """All A ids, then all B ids: neighbours alike are squeezed best."""
    return (links >> 32).astype("<u4").tobytes() + links.astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    a, b = np.frombuffer(raw, "<u4").reshape(2, -1)
    return a.astype(np.int64) << 32 | b


def link_counts(stored: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold an id pair."""
    out = _arrow_schema(stored.sparkSession, "a int, b int, n long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                codes, n = np.frombuffer(zstandard.decompress(blob), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], schema=out)

    return stored.where("kind = 1").select("links").mapInArrow(spread, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def op12_token_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    stored = _store(docs, (a_path or default_path(), b_path or default_piece_path()))
    table = link_counts(stored).toArrow()  # bounded by the vocabularies
    a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
    codes = a.astype(np.int64) << 32 | b.astype(np.int64)
    order = np.argsort(codes)
    highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(highest, b, n)
    known = spark.sparkContext.broadcast((codes[order], n[order], (n == highest[b])[order]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, (codes, counts, best) = zstandard.ZstdDecompressor(), known.value
        for batch in batches:
            links = [_unpack(expand.decompress(blob)) for blob in batch.column(5).to_pylist()]
            sizes = np.array([len(x) for x in links], np.int64)
            at = np.searchsorted(codes, np.concatenate([np.zeros(0, np.int64), *links]))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends])
            cols = [*batch.columns[:4], pa.array(sizes), pa.array(summed(best.astype(np.int64))), pa.array(summed(counts)), batch.column(4)]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return stored.where("kind = 0").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(run, schema)
