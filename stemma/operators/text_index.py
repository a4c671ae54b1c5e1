"""A positional text index that takes inserts and deletes and skips blocks of rows that can't win.

Tables of one ``SnapshotLog``; every commit is a segment, numbered by its version:

* ``postings``: term, block, key, dl, tf, positions. A row's block is a hash of its key, so all
  terms deal rows alike. Parts are dealt by a hash of (term, block) and sorted by them: a frequent term
  is spread over all files, and a reader's filters on both reach the statistics of pages. (Ranges would
  take a pass more, to sample the order.)
* ``bounds``: of each term and block of a segment, how many rows, the largest tf and the smallest
  dl / tf. A weight is 1 / (1 + a / tf + b * dl / tf) but for factors, so these two bound what any row
  of the block can score, whatever the corpus numbers are by then. A deletion adds negative counts.
* ``rows``: key, dl and the terms of each row, which a deletion needs.
* ``gone``: keys and the segment before which their postings no longer count.
* ``totals``: rows and tokens that a segment adds (or takes away).

``search`` works like block-max WAND with sets of rows instead of a cursor: the blocks with the
highest bounds are scored first, the k-th best score is the threshold, and more blocks, twice as many
each time, follow while their bounds reach it. Scores are the scan's (``search.bm25``), phrases included:
a phrase's occurrences come from positions, and since its row count is known only after looking at
all of them, a query with phrases scores all its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.snapshots import Change, SnapshotLog
from .search import _weight, query_phrases, tokens, top_k

#: Rows of a block, about, for an index that is told how many rows to expect.
BLOCK_ROWS = 128
#: Blocks up to which they are scored in order, named in the scan's filter; what is left then is joined.
MOST_NAMED = 2_000


#: Rows whose tokens are grouped at a time.
GROUPED_ROWS = 500


def grouped_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, dl, terms, positions of (key, tokens): each row's distinct terms, and the places of each, rising."""
    for whole in batches:
        for first in range(0, whole.num_rows, GROUPED_ROWS):
            batch = whole.slice(first, GROUPED_ROWS)
            said = batch.column(1)
            dl = said.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = said.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(dl)), dl)
            place = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
            group = row * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            terms = words.dictionary.take(words.indices.take(pa.array(order[starts])))
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            ends = pa.array(np.searchsorted(row[order[starts]], np.arange(len(dl) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32()), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, places)], names=["key", "dl", "terms", "positions"])


def _back(steps: int) -> Callable[[Column], Column]:
    return lambda x: x - steps


class TextIndex:
    """The index at ``path``; ``key_type`` is the SQL type of row keys, ``blocks`` fixed for its life."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", blocks: int = 64):
        self.spark, self.key_type, self.blocks = spark, key_type, blocks
        self.log = SnapshotLog(
            spark,
            path,
            {
                "postings": f"term string, block int, key {key_type}, dl int, tf int, positions array<int>, segment long",
                "bounds": "term string, block int, n long, max_tf int, least double, segment long",
                "rows": f"key {key_type}, dl int, terms array<string>, segment long",
                "gone": f"key {key_type}, segment long",
                "totals": "n long, dl long, segment long",
                "settings": "blocks int",
            },
        )
        known = self.log.read("settings").first()
        if known:
            self.blocks = known["blocks"]

    # Writing ---------------------------------------------------------------------------------

    def _block(self, key: Column | str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def _live_rows(self, base: int) -> DataFrame:
        return self._alive(self.log.read("rows", base), base)

    def _alive(self, rows: DataFrame, base: int) -> DataFrame:
        """Without rows that a later segment deleted."""
        if not self.log.manifest(base)["tables"].get("gone"):
            return rows
        gone = self.log.read("gone", base).groupBy("key").agg(F.max("segment").alias("until"))
        return rows.join(gone, "key", "left").where("until IS NULL OR segment >= until").drop("until")

    def _removal(self, keys: DataFrame, base: int) -> dict[str, DataFrame]:
        old = self._live_rows(base).join(keys.select("key").distinct(), "key", "left_semi")
        segment = F.lit(base + 1).cast("long").alias("segment")
        fewer = old.select(F.explode("terms").alias("term"), self._block().alias("block")).groupBy("term", "block").agg((-F.count("*")).alias("n"))
        return {
            "gone": old.select("key", segment),
            "bounds": fewer.select("term", "block", "n", F.lit(0).alias("max_tf"), F.lit(None).cast("double").alias("least"), segment),
            "totals": old.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("dl"), F.lit(0)).alias("dl")).select("n", "dl", segment),
        }

    def upsert(self, docs: DataFrame, key: str, text: str) -> int:
        """Index rows; those whose key is there already replace it, in the same version. Keys of ``docs`` are distinct."""
        words = docs.select(F.col(key).cast(self.key_type).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        said = cut(words.mapInArrow(grouped_tokens, f"key {self.key_type}, dl int, terms array<string>, positions array<array<int>>"))  # texts are read and grouped once; only postings are dealt
        each = said.select("key", "dl", F.explode(F.arrays_zip("terms", "positions")).alias("p"))
        posted = each.select(F.col("p.terms").alias("term"), self._block().alias("block"), "key", "dl", F.size("p.positions").alias("tf"), F.col("p.positions").alias("positions"))
        part = self.log.write_part(posted.repartition("term", "block").sortWithinPartitions("term", "block"))
        stored = self.spark.read.schema(posted.schema).parquet(f"{self.log.path}/parts/{part['id']}")

        def change(base: int) -> Change:
            segment = F.lit(base + 1).cast("long").alias("segment")
            rows = said.select("key", "dl", "terms")
            what = {name: [frame] for name, frame in (self._removal(said, base) if base else {}).items()}
            add = {
                "bounds": stored.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min(F.col("dl") / F.col("tf")).alias("least")).select("*", segment),
                "rows": rows.select("*", segment),
                "totals": rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).select("n", "dl", segment),
            }
            for name, frame in add.items():
                what.setdefault(name, []).append(frame)
            settings = {} if base else {"settings": self.spark.createDataFrame([(self.blocks,)], "blocks int")}
            return Change({name: reduce(DataFrame.unionByName, frames) for name, frames in what.items()} | settings, parts={"postings": part | {"constants": {"segment": base + 1}}}, note="upsert")

        return self.log.update(change)

    def delete(self, keys: DataFrame) -> int:
        """Take rows out by ``key``; keys that aren't there change nothing."""
        return self.log.update(lambda base: Change(self._removal(keys.select(F.col("key").cast(self.key_type).alias("key")), base), note="delete"))

    def compact(self) -> int:
        """One segment without deleted rows."""

        def change(base: int) -> Change:
            live = self._alive(self.log.read("postings", base), base)
            rows = self._live_rows(base)
            segment = F.lit(base + 1).cast("long").alias("segment")
            bounds = live.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min(F.col("dl") / F.col("tf")).alias("least"))
            totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
            anew = {"postings": live.drop("segment").repartition("term", "block").sortWithinPartitions("term", "block"), "bounds": bounds, "rows": rows.drop("segment"), "totals": totals}
            return Change(replace={name: frame.select("*", segment) for name, frame in anew.items()} | {"gone": self.log.read("gone", 0)}, note="compact")

        return self.log.update(change)

    # Reading ---------------------------------------------------------------------------------

    def _corpus(self, version: int) -> tuple[int, float]:
        r = self.log.read("totals", version).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        n = r["n"] or 0
        return n, (r["dl"] or 0) / n if n else 0.0

    def _hits(self, terms: list[str], version: int, blocks: list[int] | None = None) -> DataFrame:
        hits = self.log.read("postings", version).where(F.col("term").isin(terms))
        return self._alive(hits if blocks is None else hits.where(F.col("block").isin(blocks)), version)

    def _scored(self, hits: DataFrame, df: dict[str, int], n: int, avg: float) -> DataFrame:
        counts = F.create_map(*[F.lit(x) for t, c in df.items() for x in (t, c)])
        weight = _weight(F.col("tf"), F.lit(n), F.element_at(counts, F.col("term")), F.col("dl"), F.lit(avg))
        r = hits.groupBy("key").agg(F.sum(weight).alias("r"))
        return r.select("key", (F.greatest("r", F.lit(0.0)) / (1 + F.greatest("r", F.lit(0.0)))).alias("score"))

    def _phrase_hits(self, phrases: list[list[str]], version: int) -> DataFrame:
        """tf of each phrase (named by its words) in each row that holds it, from the positions of its words."""
        hits = self._hits(sorted({t for p in phrases for t in p}), version)
        out = []
        for p in phrases:
            name = F.lit(" ".join(p)).alias("term")
            if len(p) == 1:
                out.append(hits.where(F.col("term") == p[0]).select(name, "key", "dl", "tf"))
                continue
            places = hits.where(F.col("term").isin(p)).groupBy("key", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # a row's few words
            at = [F.transform(F.element_at(F.col("at"), w), _back(i)) for i, w in enumerate(p)]
            both = places.where(F.size("at") == len(set(p))).select(name, "key", "dl", F.size(reduce(F.array_intersect, at)).alias("tf"))
            out.append(both.where("tf > 0"))
        return reduce(DataFrame.unionByName, out)

    def scores(self, query: str, version: int | None = None) -> DataFrame:
        """key, score of every row that holds a word or phrase of the query: what ``search.bm25`` gives."""
        version = self.log.version() if version is None else version
        phrases = query_phrases(query)
        n, avg = self._corpus(version)
        if not phrases or not n:
            return self.spark.createDataFrame([], f"key {self.key_type}, score double")
        hits = self._phrase_hits(phrases, version)
        df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a phrase
        return self._scored(hits, df, n, avg) if df else self.spark.createDataFrame([], f"key {self.key_type}, score double")

    def search(self, query: str, k: int = 10, version: int | None = None) -> DataFrame:
        """The k best with their rank, ties by key: ``top_k`` of ``scores``, without scoring blocks that can't be among them."""
        version = self.log.version() if version is None else version
        phrases = query_phrases(query)
        if any(len(p) > 1 for p in phrases):
            return top_k(self.scores(query, version), k)
        terms = [p[0] for p in phrases]
        n, avg = self._corpus(version)
        bounds = self.log.read("bounds", version).where(F.col("term").isin(terms)).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("least").alias("least"))
        df = {r["term"]: r["n"] for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0").collect()}
        if not df:
            return top_k(self.scores(query, version), k)
        counts = F.create_map(*[F.lit(x) for t, c in df.items() for x in (t, c)])
        most = _weight(F.col("max_tf"), F.lit(n), F.element_at(counts, F.col("term")), F.col("least") * F.col("max_tf"), F.lit(avg))
        blocks = bounds.where("n > 0").groupBy("block").agg(F.sum(most).alias("r")).select("block", (F.col("r") / (1 + F.col("r")) + 1e-12).alias("most"))
        ordered = blocks.orderBy(F.desc("most"), "block").limit(MOST_NAMED).collect()
        known, best, threshold, at, size = list(df), [], -1.0, 0, k
        while at < len(ordered) and ordered[at]["most"] >= threshold:  # each holds a row at least
            named = [r["block"] for r in ordered[at : at + size] if r["most"] >= threshold]
            found = self._scored(self._hits(known, version, named), df, n, avg).orderBy(F.desc("score"), "key").limit(k)
            best = sorted([*best, *map(tuple, found.collect())], key=lambda r: (-r[1], r[0]))[:k]
            threshold = best[-1][1] if len(best) == k else -1.0
            at, size = at + len(named), 2 * size
        self.scored_blocks = at
        top = self.spark.createDataFrame(best, f"key {self.key_type}, score double")
        if len(ordered) < MOST_NAMED or at < len(ordered):
            return top_k(top, k)
        other = blocks.where(F.col("most") >= threshold).join(F.broadcast(self.spark.createDataFrame([(r["block"],) for r in ordered], "block int")), "block", "left_anti")  # MOST_NAMED rows
        hits = self._hits(known, version).join(other.select("block"), "block", "left_semi")
        return top_k(top.unionByName(self._scored(hits, df, n, avg)), k)


def build_index(docs: DataFrame, key: str, text: str, path: str) -> TextIndex:
    """A new index of all rows, with blocks of about ``BLOCK_ROWS`` rows."""
    n = docs.count()
    index = TextIndex(docs.sparkSession, path, dict(docs.dtypes)[key], max(16, n // BLOCK_ROWS))
    index.upsert(docs, key, text)
    return index
