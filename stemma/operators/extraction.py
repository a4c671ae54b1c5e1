"""Model answers into validated, document-based proposals; evaluation against gold; critic answers."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S | re.I)


def key_of(name: str) -> str:
    """The Python form of ``functions.text.normalize_name``."""
    folded = name.casefold()
    bare = re.sub("[^0-9a-z]+", "", folded)
    return bare if len(bare) > 3 else re.sub(r"\s+", "", folded)


def locate(text: str, surface: str) -> tuple[int, int] | None:
    """Where a surface stands: as written in either case, else its letters and digits with anything else between."""
    if surface and (m := re.search(re.escape(surface), text, re.I)):
        return m.span()
    letters = re.sub("[^0-9a-z]+", "", surface.casefold())
    folded = text.casefold()
    m = re.search("[^0-9a-z]*".join(letters), folded) if letters else None
    if m is None or len(folded) == len(text):
        return m and m.span()
    reach = list(accumulate(len(c.casefold()) for c in text))  # folded characters up to and with each one
    return bisect_right(reach, m.start()), bisect_right(reach, m.end() - 1) + 1


@dataclass
class Answer:
    """What one model answer gives: rows of (kind, fields) and what was wrong with it."""

    offset: int
    text: str
    schema: dict
    entities: dict[tuple[str, str], dict] = field(default_factory=dict)
    relations: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def span(self, raw: object, surface: str) -> tuple[int, int] | None:
        try:
            a, b = int(raw["start"]), int(raw["end"])  # type: ignore[index]
            cited = self.text[a:b] if 0 <= a < b <= len(self.text) else ""
        except (KeyError, TypeError, ValueError):
            cited = ""
        if cited and (surface.casefold() in cited.casefold() or locate(cited, surface)):
            return a, b
        found = locate(self.text, surface)
        if cited and found:
            self.warnings.append(f"{surface}: span moved to the name")
        return found

    def entity(self, raw: object) -> None:
        name = raw.get("name") if isinstance(raw, dict) else None
        kind = raw.get("entity_type") if isinstance(raw, dict) else None
        if not isinstance(name, str) or not name.strip() or kind not in self.schema["entities"]:
            self.warnings.append(f"entity {name!r} of type {kind!r}: rejected")
            return
        name = name.strip()
        place = self.span(raw.get("source_span"), name)
        if place is None:
            self.warnings.append(f"entity {name!r}: not in the text, rejected")
            return
        aliases = [a.strip() for a in raw.get("aliases") or [] if isinstance(a, str) and a.strip()]
        known = self.entities.get((key_of(name), kind))
        if known:
            have = {key_of(x) for x in (known["name"], *known["aliases"])}
            for a in (name, *aliases):
                if key_of(a) not in have:
                    have.add(key_of(a))
                    known["aliases"].append(a)
            return
        allowed = self.schema["entities"][kind]
        kept = {}
        for p, v in (raw.get("properties") or {}).items():
            if p in allowed and (not allowed[p] or v in allowed[p]):
                kept[p] = v if isinstance(v, str) else json.dumps(v)
            else:
                self.warnings.append(f"entity {name!r}: property {p!r} dropped")
        try:
            confidence = min(1.0, max(0.0, float(raw.get("confidence"))))
        except (TypeError, ValueError):
            confidence = None
        self.entities[(key_of(name), kind)] = {"name": name, "type": kind, "aliases": aliases, "properties": kept, "confidence": confidence, "span": place, "synthesized": False}

    def endpoint(self, raw: object) -> dict | None:
        name = raw.get("name") if isinstance(raw, dict) else None
        kind = raw.get("entity_type") if isinstance(raw, dict) else None
        if not isinstance(name, str) or not name.strip() or kind not in self.schema["entities"]:
            self.warnings.append(f"endpoint {name!r} of type {kind!r}: rejected")
            return None
        key = (key_of(name), kind)
        if key not in self.entities:
            self.warnings.append(f"endpoint {name.strip()!r}: synthesized")
            self.entities[key] = {"name": name.strip(), "type": kind, "aliases": [], "properties": {}, "confidence": None, "span": locate(self.text, name.strip()), "synthesized": True}
        return self.entities[key]

    def relation(self, raw: object) -> None:
        kind = raw.get("relation_type") if isinstance(raw, dict) else None
        if kind not in self.schema["relations"]:
            self.warnings.append(f"relation {kind!r}: rejected")
            return
        a, b = self.endpoint(raw.get("source")), self.endpoint(raw.get("target"))
        if a is None or b is None:
            return
        domain, range_ = self.schema["relations"][kind]
        if domain not in ("*", a["type"]) or range_ not in ("*", b["type"]):
            self.warnings.append(f"relation {kind}: {a['type']} to {b['type']} is outside its domain and range")
            return
        self.relations.append({"type": kind, "src": a, "dst": b})

    def rows(self) -> Iterator[tuple]:
        """kind, type, name, src, dst, aliases, properties, confidence, start, end, synthesized."""
        at = lambda s: (None, None) if s is None else (self.offset + s[0], self.offset + s[1])
        for e in self.entities.values():
            yield ("entity", e["type"], e["name"], None, None, e["aliases"], e["properties"], e["confidence"], *at(e["span"]), e["synthesized"])
        for r in self.relations:
            yield ("relation", r["type"], None, r["src"]["name"], r["dst"]["name"], None, None, None, None, None, False)
        for w in self.warnings:
            yield ("warning", None, w, None, None, None, None, None, None, None, False)


def read_answer(answer: str | None, text: str, offset: int, schema: dict) -> Answer:
    """Validate one answer; one that can't be read at all gives a single warning."""
    out = Answer(offset, text, schema)
    block = _FENCE.search(answer or "")
    try:
        payload = json.loads(block[1]) if block else None
    except ValueError:
        payload = None
    if not isinstance(payload, dict):
        out.warnings.append("no JSON object in the answer")
        return out
    for raw in payload.get("entities") or []:
        out.entity(raw)
    for raw in payload.get("relations") or []:
        out.relation(raw)
    return out


ROWS = "kind string, type string, name string, src string, dst string, aliases array<string>, properties map<string,string>, confidence double, start int, end int, synthesized boolean"


def parse_answers(chunks: DataFrame, schema: dict, key: str = "doc_id") -> DataFrame:
    """Proposals of (key, char_offset, text, answer). schema: {"entities": {type: {property: allowed values or []}}, "relations": {type: (domain, range)}}."""
    kind = dict(chunks.dtypes)[key]
    names = [c.strip().split(" ")[0] for c in ROWS.replace("map<string,string>", "map").split(",")]

    def run(batches):
        for pdf in batches:
            rows = [(k, *r) for k, offset, text, answer in pdf.itertuples(index=False, name=None) for r in read_answer(answer, text, offset, schema).rows()]
            out = pd.DataFrame(rows, columns=[key, *names])
            for c in ("start", "end"):
                out[c] = out[c].astype("Int32")
            yield out

    return chunks.select(key, "char_offset", "text", "answer").mapInPandas(run, f"{key} {kind}, {ROWS}")


def stream_filter(rows: DataFrame, engine: str | None = None, model: str | None = None, prompt_version: str | None = None, decode_params: str | None = None) -> DataFrame:
    """Rows of one extraction stream; None leaves a field open."""
    for c, v in (("extractor_engine", engine), ("extractor_model", model), ("prompt_version", prompt_version), ("decode_params", decode_params)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows


def decode_key(params: Column) -> Column:
    """Decode parameters (a map) as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def load_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities by key, triples by keys) of a gold file; entries without their fields are an error."""
    from ..functions.text import normalize_name

    raw = spark.read.schema("entities array<struct<name: string>>, triples array<struct<src: string, relation: string, dst: string>>").json(path, multiLine=True)
    need = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit("gold entry without a field")).cast("string")).otherwise(c)
    e = raw.select(F.explode("entities").alias("e")).select(normalize_name(need(F.col("e.name"))).alias("name")).distinct()
    t = raw.select(F.explode("triples").alias("t")).select(normalize_name(need(F.col("t.src"))).alias("src"), need(F.col("t.relation")).alias("relation"), normalize_name(need(F.col("t.dst"))).alias("dst")).distinct()
    return e, t


def parse_critic(answers: DataFrame, items: DataFrame) -> DataFrame:
    """id, score (clamped), rationale of known items in fenced JSON arrays; the rest is dropped."""
    from ..functions.text import fenced_block

    rows = answers.select(F.explode(F.from_json(fenced_block(F.col("answer")), "array<struct<id: string, score: double, rationale: string>>")).alias("r")).where("r.id IS NOT NULL AND r.score IS NOT NULL")
    known = rows.select("r.id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "r.score")).alias("score"), F.substring("r.rationale", 1, 500).alias("rationale"))
    return known.join(items.select("id"), "id", "left_semi")


def critic_stats(candidates: DataFrame, scored: DataFrame, gap: float = 0.35) -> DataFrame:
    """One row: candidates, skipped_uncited, scored, disagreements. Candidates carry id, confidence and cited."""
    both = candidates.join(scored.select("id", "score"), "id", "left")
    return both.agg(F.count("*").alias("candidates"), F.count_if(~F.col("cited")).alias("skipped_uncited"), F.count_if(F.col("score").isNotNull()).alias("scored"), F.count_if(F.abs(F.col("confidence") - F.col("score")) >= gap).alias("disagreements"))
