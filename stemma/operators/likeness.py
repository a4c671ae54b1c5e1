"""Pairs of one type that look alike: by name, containment, a shared alias or the cosine of their vectors.

Every two nodes of a type meet, so no pair is lost, neither for parts of names that many share nor
for whole names that many bear. Nodes are dealt to blocks by id and every two blocks meet in one task:
no task holds a whole type, and pairs leave it in small batches. What is cheap (lengths, counted
letters) is worked out for all names of two blocks at once. The ratio itself is difflib's; it depends
only on which letters of two names are equal, so that names that part after a long common beginning
are rated once for each pattern of their ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import SHARED, number_keys, spread, unit_rows

#: ``PIECES`` blocks share a type where each then has over ``SHARED`` nodes, more where one would have over ``BLOCK``; a step compares up to ``CELLS`` pairs.
PIECES, BLOCK, CELLS = 16, 16_384, 262_144
#: Names of up to ``SHORT`` letters with ends of up to ``END`` may be rated by pattern; letters are counted in ``BINS``.
SHORT, END, BINS, PATTERN_BITS = 63, 16, 64, 62
#: Of how many pairs of names and patterns of ends a task remembers the ratio.
PAIRS, PATTERNS = 200_000, 4_000_000


def matches(a: str, b: str) -> int:
    return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


class Names:
    """Different names with their lengths, counted letters and, up to ``SHORT`` letters, codes."""

    def __init__(self, names: np.ndarray):
        self.names = names
        n = len(names)
        self.length = np.array([len(x) for x in names], np.int64)
        letters = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n), self.length)
        self.counts = np.bincount(owner * BINS + letters % BINS, minlength=n * BINS).reshape(n, BINS)
        self.codes = np.zeros((n, SHORT), np.uint32)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        short = place < SHORT
        self.codes[owner[short], place[short]] = letters[short]
        self.echo = self._echo()

    def _echo(self) -> np.ndarray:
        """[name, r]: the longest run of letters that repeats itself up to r - 1 places on."""
        out = np.zeros((len(self.names), END + 1), np.int64)
        for d in range(1, END):
            same = (self.codes[:, :-d] == self.codes[:, d:]) & (np.arange(d, SHORT) < self.length[:, None])
            run, most = np.zeros(len(same), np.int64), out[:, d].copy()
            for column in same.T:
                run = (run + 1) * column
                np.maximum(most, run, out=most)
            out[:, d + 1] = most
        return out


class Ratios:
    """difflib's ratios of many pairs of names; what is rated once is remembered."""

    def __init__(self):
        self.pairs: dict[tuple[str, str], float] = {}
        self.ends: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # patterns in order, with the letters that match

    def of(self, a: Names, i: np.ndarray, b: Names, j: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The ratio of each ``a.names[i]``, ``b.names[j]``; ``common`` is how many letters they begin with in common.

        Where no other letters that both share are as many as the common beginning, difflib takes this
        first, and then compares the two ends. Others can't be where the ends are no longer than
        the beginning, and it does not repeat itself.
        """
        la, lb = a.length[i], b.length[j]
        ra, rb = la - common, lb - common
        far = np.maximum(ra, rb)
        quick = (la <= SHORT) & (lb <= SHORT) & (far <= END) & (far <= common) & (ra * rb <= PATTERN_BITS)
        quick &= a.echo[i, np.minimum(far, END)] < common - far + 1
        matched = np.zeros(len(i))
        group = np.where(quick, (common * 64 + la) * 64 + lb, -1)
        for g in np.unique(group[quick]):
            at = np.flatnonzero(group == g)
            matched[at] = self._by_ends(a, i[at], b, j[at], int(g) >> 12)
        slow = np.flatnonzero(~quick)
        matcher, last = SequenceMatcher(None, "", ""), -1
        out = 2.0 * matched / (la + lb)
        for t in slow[np.argsort(j[slow], kind="stable")]:
            x, y = a.names[i[t]], b.names[j[t]]
            ratio = self.pairs.get((x, y))
            if ratio is None:
                if last != j[t]:
                    matcher.set_seq2(y)  # difflib keeps what it knows of the second one
                    last = j[t]
                matcher.set_seq1(x)
                if len(self.pairs) >= PAIRS:
                    self.pairs.clear()
                ratio = self.pairs[x, y] = matcher.ratio()
            out[t] = ratio
        return out

    def _by_ends(self, a: Names, i: np.ndarray, b: Names, j: np.ndarray, common: int) -> np.ndarray:
        """How many letters match, of pairs with the same lengths and ``common``."""
        ra, rb = int(a.length[i[0]]) - common, int(b.length[j[0]]) - common
        x, y = a.codes[i, common : common + ra].T, b.codes[j, common : common + rb].T
        pattern = np.zeros(len(i), np.int64)
        for u in range(ra):
            for v in range(rb):
                pattern |= (x[u] == y[v]).astype(np.int64) << (u * rb + v)
        found, first, which = np.unique(pattern, return_index=True, return_inverse=True)
        known, sizes = self.ends.get((ra, rb), (found[:0], np.zeros(0, np.int8)))
        at = np.searchsorted(known, found)
        new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != found) if len(known) else np.arange(len(found))
        if len(new):
            fresh = [matches(a.names[i[t]][common:], b.names[j[t]][common:]) for t in first[new]]
            known, sizes = np.insert(known, at[new], found[new]), np.insert(sizes, at[new], fresh)
            if sum(len(k) for k, _ in self.ends.values()) >= PATTERNS:
                self.ends.clear()
            self.ends[ra, rb] = known, sizes
        return common + sizes[np.searchsorted(known, found)][which].astype(np.int64)


class Block:
    """Nodes of one type, in the order of their names."""

    def __init__(self, rows: pd.DataFrame):
        names, at = np.unique(rows["name"].fillna("").to_numpy(object), return_inverse=True)
        order = np.argsort(at, kind="stable")
        rows = rows.iloc[order]
        self.ids, self.at, self.names = rows["id"].to_numpy(), at[order], Names(names)
        self.empty = (rows["name"] == "").to_numpy()
        self.keys = rows["keys"].tolist()
        self.with_vector = np.flatnonzero(rows["vector"].notna())
        self.vectors = unit_rows(rows["vector"].iloc[self.with_vector]) if len(self.with_vector) else None

    def holders(self) -> dict[str, np.ndarray]:
        """The places of the nodes that have a key."""
        found: dict[str, list[int]] = {}
        for place, keys in enumerate(self.keys):
            for k in keys if keys is not None else ():
                found.setdefault(k, []).append(place)
        return {k: np.array(v) for k, v in found.items()}


class Comparison:
    """Two blocks that meet, or one with itself."""

    def __init__(self, x: Block, y: Block, ratios: Ratios, least: float, contained: int | None, cosine: float):
        self.x, self.y, self.ratios, self.least, self.contained, self.cosine = x, y, ratios, least, contained, cosine
        self.rank_x, self.rank_y = number_keys(x.ids, y.ids)
        self.ends_x, self.ends_y = self._ends(x, self.rank_x), self._ends(y, self.rank_y)
        self.same_name = {name: at for at, name in enumerate(y.names.names) if name}
        self.holders = y.holders()
        self.bins = np.flatnonzero(x.names.counts.any(0) & y.names.counts.any(0))
        kind = np.int16 if max(x.names.length.max(), y.names.length.max()) < 2**14 else np.int64
        self.counts_x, self.counts_y = (np.ascontiguousarray(b.names.counts[:, self.bins].T.astype(kind)) for b in (x, y))
        narrow = np.uint8 if max(x.names.codes.max(), y.names.codes.max()) < 256 else np.uint32
        self.codes_x, self.codes_y = (np.ascontiguousarray(b.names.codes.T.astype(narrow)) for b in (x, y))

    @staticmethod
    def _ends(block: Block, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and the highest rank of a name's bearers."""
        n = len(block.names.names)
        low, high = np.full(n, len(rank) * 2 + 2**31), np.full(n, -1)
        np.minimum.at(low, block.at, rank)
        np.maximum.at(high, block.at, rank)
        return low, high

    def by_name(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of x's names lo to hi and all of y's: the ratio with x's first and with y's first (NaN below ``least``), and whether one contains the other."""
        x, y = self.x.names, self.y.names
        lx, ly = x.length[lo:hi, None], y.length[None, :]
        shared = np.zeros((hi - lo, len(y.names)), self.counts_x.dtype)
        for cx, cy in zip(self.counts_x[:, lo:hi], self.counts_y):
            shared += np.minimum(cx[:, None], cy[None, :])
        whole = lx + ly
        first, second = np.full(shared.shape, np.nan), np.full(shared.shape, np.nan)
        near = (lx > 0) & (ly > 0) & (2.0 * shared / np.maximum(whole, 1) >= self.least)
        for i in range(lo, hi):
            j = self.same_name.get(x.names[i])
            if j is not None:
                near[i - lo, j] = False
                if self.least <= 1.0:
                    first[i - lo, j] = second[i - lo, j] = 1.0
        i, j = np.nonzero(near)
        if len(i):
            common = self._common(lo, hi)[i, j]
            forth = np.flatnonzero(self.ends_x[0][i + lo] < self.ends_y[1][j])
            back = np.flatnonzero(self.ends_x[1][i + lo] > self.ends_y[0][j]) if self.x is not self.y else forth[:0]
            for out, at, flip in ((first, forth, False), (second, back, True)):
                ends = [(x, i[at] + lo), (y, j[at])]
                (a, p), (b, q) = ends[::-1] if flip else ends
                ratio = self.ratios.of(a, p, b, q, common[at])
                out[i[at], j[at]] = np.where(ratio >= self.least, ratio, np.nan)
        return first, second, self._inside(lo, shared, lx, ly) if self.contained is not None else None

    def _common(self, lo: int, hi: int) -> np.ndarray:
        """With how many letters, ``SHORT`` at most, two names begin in common."""
        out = np.zeros((hi - lo, len(self.y.names.names)), np.int64)
        alive = np.ones(out.shape, bool)
        for cx, cy in zip(self.codes_x[:, lo:hi], self.codes_y):
            alive &= cx[:, None] == cy[None, :]
            if not alive.any():
                break
            out += alive
        return np.minimum(out, np.minimum(self.x.names.length[lo:hi, None], self.y.names.length[None, :]))

    def _inside(self, lo: int, shared: np.ndarray, lx: np.ndarray, ly: np.ndarray) -> np.ndarray:
        shorter = np.minimum(lx, ly)
        out = (shorter >= self.contained) & (lx != ly) & (shared >= shorter)
        for i, j in zip(*np.nonzero(out)):
            a, b = self.x.names.names[i + lo], self.y.names.names[j]
            out[i, j] = a in b or b in a
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Places of the lower and of the higher id (y's behind x's), ratio, containment, shared key and cosine of the pairs that have any of these."""
        x, y = self.x, self.y
        step = max(1, CELLS // len(y.ids))
        for lo in range(0, len(x.ids), step):
            hi = min(lo + step, len(x.ids))
            rank = self.rank_x[lo:hi, None]
            forth = rank < self.rank_y
            live = forth if x is y else rank != self.rank_y
            first, second, inside = self.by_name(x.at[lo], x.at[hi - 1] + 1)
            cells = np.ix_(x.at[lo:hi] - x.at[lo], y.at)
            alike = first[cells] if x is y else np.where(forth, first[cells], second[cells])
            inside = np.zeros(forth.shape, bool) if inside is None else inside[cells]
            alias, near = self._alias(lo, hi), self._near(lo, hi)
            if x.empty[lo:hi].any() and y.empty.any():  # empty names are equal, but that alone says nothing
                alike[x.empty[lo:hi, None] & y.empty & (alias | ~np.isnan(near))] = 1.0
            i, j = np.nonzero(live & (~np.isnan(alike) | inside | alias | ~np.isnan(near)))
            if len(i):
                up, p, q = forth[i, j], i + lo, j + len(x.ids)
                yield np.where(up, p, q), np.where(up, q, p), alike[i, j], inside[i, j], alias[i, j], near[i, j]

    def _alias(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, len(self.y.ids)), bool)
        for row, keys in zip(out, self.x.keys[lo:hi]):
            for k in keys if keys is not None else ():
                held = self.holders.get(k)
                if held is not None:
                    row[held] = True
        return out

    def _near(self, lo: int, hi: int) -> np.ndarray:
        x, y = self.x, self.y
        out = np.full((hi - lo, len(y.ids)), np.nan)
        a, b = np.searchsorted(x.with_vector, [lo, hi])
        if a < b and len(y.with_vector):
            cos = np.round(x.vectors[a:b] @ y.vectors.T, 12)
            out[np.ix_(x.with_vector[a:b] - lo, y.with_vector)] = np.where(cos >= self.cosine, cos, np.nan)
        return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each run of equal ``keys``: one block pair at a time."""
    held: list[pd.DataFrame] = []
    for rows in (b.to_pandas() for b in batches if b.num_rows):
        k = rows[keys]
        starts = np.flatnonzero((k != k.shift()).any(axis=1))
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            piece = rows.iloc[lo:hi]
            if held and tuple(held[0][keys].iloc[0]) != tuple(piece[keys].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held, ignore_index=True)


def met(nodes: DataFrame) -> DataFrame:
    """Rows with a type ``g``, dealt so that every two blocks (i, j) of a type lie behind one another in one partition, i's rows on side 0 and j's on side 1."""
    pieces = F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.lit(PIECES), F.ceil(F.count("*") / SHARED))).cast("int")
    sized = nodes.where("g IS NOT NULL").groupBy("g").agg(pieces.alias("blocks"))
    own = nodes.join(F.broadcast(sized), "g").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # a row a type
    far = own.withColumn("far", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = far.select("g", F.least("blk", "far").alias("i"), F.greatest("blk", "far").alias("j"), (F.col("blk") > F.col("far")).cast("int").alias("side"), *[c for c in nodes.columns if c != "g"])
    return spread(dealt, "g", "i", "j").sortWithinPartitions("g", "i", "j")


def signal_pairs(nodes: DataFrame, ratio: float, contained: int | None = None, keys: str | None = None, vector: str | None = None, cosine: float = 0.9) -> DataFrame:
    """a, b, alike, inside, alias, near of the pairs a < b of one type that have any of these signals.

    ``alike``: the ratio of the names where it reaches ``ratio``; ``inside``: the shorter name, of
    ``contained`` letters or more, is part of the other; ``alias``: a key that isn't empty is shared;
    ``near``: the cosine where it reaches ``cosine``. Names that are empty or null are like no other.
    """
    kind = dict(nodes.dtypes)["id"]
    known = F.filter(F.array_distinct(keys), lambda k: k != "") if keys else F.lit(None).cast("array<string>")
    vectors = F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")
    rows = nodes.select(F.col("entity_type").alias("g"), "id", F.col("normalized_name").alias("name"), known.alias("keys"), vectors.alias("vector"))
    return met(rows).mapInArrow(compare(ratio, contained, cosine), f"a {kind}, b {kind}, alike double, inside boolean, alias boolean, near double")


def compare(ratio: float, contained: int | None, cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios()
        for rows in runs(batches, ["g", "i", "j"]):
            x, y = (rows[rows["side"] == s] for s in (0, 1))
            alone = rows["i"].iloc[0] == rows["j"].iloc[0]
            if x.empty or (y.empty and not alone):
                continue
            left = Block(x)
            right = left if alone else Block(y)
            ids = pa.concat_arrays([pa.array(left.ids), pa.array(right.ids)])
            for a, b, alike, inside, alias, near in Comparison(left, right, ratios, ratio, contained, cosine).pairs():
                score = lambda v: pa.array(v, mask=np.isnan(v))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), score(alike), pa.array(inside), pa.array(alias), score(near)], names=["a", "b", "alike", "inside", "alias", "near"])

    return run
