"""Name registries: imports that refuse conflicts, lookups, and proposal normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cas_valid, surface_key


def surface_conflicts(rows: DataFrame, surface: str = "surface", code: str = "code") -> DataFrame:
    """Surfaces that name more than one code."""
    return rows.groupBy(surface).agg(F.count_distinct(code).alias("codes")).where("codes > 1")


def build_registry(rows: DataFrame, surface: str = "surface", code: str = "code") -> DataFrame:
    """surface, code; raises at run time where a surface has two codes. Repeats collapse."""
    one = F.when(F.min(code) == F.max(code), F.min(code)).otherwise(F.raise_error(F.concat(F.lit("conflicting codes for "), F.first(surface))).cast("string"))
    return rows.groupBy(surface).agg(one.alias(code))


def import_eppo(spark: SparkSession, path: str) -> DataFrame:
    """code, name, type of an export with a header, whatever its column names' case."""
    raw = spark.read.csv(path, header=True)
    aliases = {"code": {"code", "eppocode", "eppo_code"}, "name": {"name", "fullname", "full_name"}, "type": {"type", "nametype", "name_type"}}
    found = {k: c for k, names in aliases.items() for c in raw.columns if c.strip().lower() in names}
    if not {"code", "name"} <= found.keys():
        raise ValueError("an export needs code and name columns")
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(k) for k, c in found.items()])


def eppo_registry(spark: SparkSession, path: str) -> DataFrame:
    """surface, code of an export, surfaces folded; a surface of two codes is an error."""
    return build_registry(import_eppo(spark, path).select(surface_key(F.col("name")).alias("surface"), "code").where("surface <> '' AND code <> ''"))


def read_pubchem(spark: SparkSession, path: str) -> DataFrame:
    """cid, surface of a dump of ``CID<TAB>synonym`` lines (gzip or not); another line is an error."""
    parts = F.split("value", "\t")
    cid, surface = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    fault = F.when(F.size(parts) != 2, "not CID<TAB>synonym").when(~cid.rlike("^[0-9]+$"), "CID isn't a number").when(surface == "", "empty synonym")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), "value")).cast("string"))
    return spark.read.text(path).select(F.coalesce(checked, cid).alias("cid"), surface.alias("surface"))


def import_pubchem(synonyms: DataFrame) -> DataFrame:
    """surface (folded), code: synonyms (cid, surface) joined by compound to its CAS number.

    A compound of two valid CAS numbers, a surface of two codes and a synonym that folds to nothing
    are errors; compounds without a CAS number have no rows.
    """
    cas = synonyms.where(cas_valid(F.col("surface"))).groupBy("cid").agg(F.min("surface").alias("code"), F.max("surface").alias("other"))
    one = F.when(F.col("code") == F.col("other"), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("several CAS numbers for compound "), F.col("cid").cast("string"))).cast("string"))
    key = surface_key(F.col("surface"))
    folded = F.when(key != "", key).otherwise(F.raise_error(F.concat(F.lit("synonym without letters: "), "surface")).cast("string"))
    return build_registry(synonyms.select("cid", folded.alias("surface")).join(cas.select("cid", one.alias("code")), "cid").select("surface", "code"))


def resolve(rows: DataFrame, registry: DataFrame, surface: str = "surface") -> DataFrame:
    """``rows`` with code and status (resolved, unresolved)."""
    out = rows.join(registry.select(F.col("surface").alias(surface), "code"), surface, "left")
    return out.withColumn("status", F.when(F.col("code").isNotNull(), "resolved").otherwise("unresolved"))


def resolve_with_absence(rows: DataFrame, registry: DataFrame | None, surface: str = "surface") -> DataFrame:
    """``resolve`` where the registry may not have been imported yet: then every status is ``cache_absent``."""
    if registry is None:
        return rows.withColumns({"code": F.lit(None).cast("string"), "status": F.lit("cache_absent")})
    return resolve(rows, registry, surface)


def normalize_proposals(proposals: DataFrame, registry: DataFrame | None, field: str) -> DataFrame:
    """Properties with the registry's code under ``field``: the first of (name, aliases...) that resolves wins.

    A differing value that was there moves to ``<field>_dropped``; a miss is flagged. Without an
    imported registry nothing changes.
    """
    if registry is None:
        return proposals
    surfaces = proposals.select("id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "raw")).withColumn("surface", surface_key(F.col("raw")))
    best = resolve(surfaces, registry).where("code IS NOT NULL").groupBy("id").agg(F.min_by("code", "pos").alias("code"))
    joined = proposals.join(best, "id", "left")
    old = F.element_at("properties", field)
    rest = F.map_filter("properties", lambda k, _: k != field)
    dropped = F.when(old.isNotNull() & (old != F.coalesce("code", F.lit(""))), F.create_map(F.lit(f"{field}_dropped"), old)).otherwise(F.create_map().cast("map<string,string>"))
    said = F.when(F.col("code").isNotNull(), F.create_map(F.lit(field), F.col("code"))).otherwise(F.create_map(F.lit(f"{field}_missing"), F.lit("true")))
    return joined.withColumn("properties", F.map_concat(rest, dropped, said)).drop("code")


# What a registry knows of a proposal. Entity types, then the properties for the code, the
# name that matched, a differing code that was there, and the flag of a miss.
DOMAINS = {
    "eppo": (("Crop", "Pathogen", "Pest", "Weed"), "eppo_code", "eppo_matched_surface", "eppo_code_dropped", "no_eppo_match"),
    "cas": (("ActiveIngredient",), "cas_number", "cas_matched_surface", "cas_number_dropped", "no_cas_match"),
}
MOA_SCHEMES = ("FRAC", "IRAC", "HRAC")
MOA_FIELDS = ("moa_scheme", "moa_code")


def moa_registry(rows: DataFrame) -> DataFrame:
    """cas_number, scheme, code of mode-of-action rows; raises at run time on an invalid or conflicting one. Repeats collapse."""
    cas, scheme, code = F.trim("cas_number"), F.upper(F.trim("scheme")), F.trim("code")
    valid = F.coalesce(cas_valid(cas) & scheme.isin(*MOA_SCHEMES) & (code != ""), F.lit(False))
    said = F.concat_ws(", ", F.lit("invalid mode of action"), "cas_number", "scheme", "code")
    checked = rows.select(F.when(valid, cas).otherwise(F.raise_error(said).cast("string")).alias("cas_number"), F.struct(scheme.alias("scheme"), code.alias("code")).alias("moa"))
    one = F.when(F.min("moa") == F.max("moa"), F.min("moa")).otherwise(F.raise_error(F.concat(F.lit("conflicting modes of action for "), F.first("cas_number"))).cast("struct<scheme: string, code: string>"))
    return checked.groupBy("cas_number").agg(one.alias("moa")).select("cas_number", "moa.scheme", "moa.code")


def normalize_domain(proposals: DataFrame, registry: DataFrame | None, domain: str, moa: DataFrame | None = None) -> DataFrame:
    """Proposals (id, entity_type, name, aliases, properties) with what a registry (surface, code) says of its entity types.

    The first of (name, aliases...) that the registry knows gives the code and is noted; a code that
    the proposal came with stays only as what was dropped, where it differs. A miss is flagged.
    Modes of action (``moa_registry``) come from the code alone, never from the proposal. Without an
    imported registry the proposal's own code goes and nothing is flagged. Rows of other entity types
    stay as they are; null aliases and properties count as empty. Ids are distinct.
    """
    types, code, matched, dropped, miss = DOMAINS[domain]
    own = [code, *(MOA_FIELDS if domain == "cas" else ())]
    mine = F.coalesce(F.col("entity_type").isin(*types), F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    had = F.coalesce("properties", empty)
    marks = [matched, dropped, "normalization"]
    rest = F.map_filter(had, lambda k, _: ~k.isin(*own, *marks))
    if registry is None:
        return proposals.withColumn("properties", F.when(mine, rest).otherwise(F.col("properties")))
    surfaces = proposals.where(mine).select("id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "raw"))
    known = surfaces.withColumn("surface", surface_key(F.col("raw"))).join(registry.select("surface", F.col("code").alias("_code")), "surface")
    best = known.groupBy("id").agg(F.min_by(F.struct("_code", "raw"), "pos").alias("_hit")).select("id", "_hit._code", F.col("_hit.raw").alias("_raw"))
    if moa is not None and domain == "cas":
        best = best.join(moa.select(F.col("cas_number").alias("_code"), F.col("scheme").alias("_scheme"), F.col("code").alias("_moa")), "_code", "left")
    else:
        best = best.withColumns({"_scheme": F.lit(None).cast("string"), "_moa": F.lit(None).cast("string")})
    before = F.element_at(had, F.lit(code))
    hit = F.col("_code").isNotNull()
    only = lambda when, *kv: F.when(when, F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])).otherwise(empty)
    found = only(hit, code, F.col("_code"), matched, F.col("_raw"))
    action = only(hit & F.col("_scheme").isNotNull(), MOA_FIELDS[0], F.col("_scheme"), MOA_FIELDS[1], F.col("_moa"))
    lost = only(before.isNotNull() & ~before.eqNullSafe(F.col("_code")), dropped, before)
    missed = only(~hit, "normalization", F.lit(miss))
    said = F.map_concat(rest, found, action, lost, missed)
    return proposals.join(best, "id", "left").withColumn("properties", F.when(mine, said).otherwise(F.col("properties"))).select(*proposals.columns)


# Curated resources: a record counts only where its symbol is the name asked for.

RESOURCES = {
    "uniprot": ("results array<struct<primaryAccession: string, genes: array<struct<geneName: struct<value: string>>>, proteinDescription: struct<recommendedName: struct<fullName: struct<value: string>>>>>", "results", "r.genes[0].geneName.value", "r.primaryAccession", "r.proteinDescription.recommendedName.fullName.value"),
    "mygene": ("hits array<struct<_id: string, symbol: string, name: string>>", "hits", "r.symbol", "r._id", "r.name"),
    "ensembl": ("hits array<struct<id: string, display_name: string, description: string>>", "hits", "r.display_name", "r.id", "r.description"),
    "chembl": ("molecules array<struct<molecule_chembl_id: string, pref_name: string, molecule_type: string>>", "molecules", "r.pref_name", "r.molecule_chembl_id", "r.molecule_type"),
}
REGISTRY_OF = {"Gene": "uniprot", "Protein": "uniprot", "Drug": "pubchem", "Variant": "clinvar"}


def parse_resource(payloads: DataFrame, resource: str) -> DataFrame:
    """name, accession, fact (600 characters at most) of exact symbol matches in (name, payload)."""
    schema, path, symbol, accession, fact = RESOURCES[resource]
    rows = payloads.select("name", F.explode(F.from_json("payload", schema)[path]).alias("r"))
    return rows.where(F.upper(F.expr(symbol)) == F.upper("name")).select("name", F.expr(accession).alias("accession"), F.substring(F.expr(fact), 1, 600).alias("fact"))


def registry_for(entity_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in REGISTRY_OF.items() for x in kv]), entity_type)


# Registry hints: one registry a type of entity, one row a name, failures included.

_UNIPROT = "struct<results: array<struct<primaryAccession: string, proteinDescription: struct<recommendedName: struct<fullName: struct<value: string>>>, genes: array<struct<geneName: struct<value: string>>>, organism: struct<scientificName: string>>>>"
_PUBCHEM = "struct<PropertyTable: struct<Properties: array<struct<CID: string, Title: string, MolecularFormula: string>>>>"
_CLINVAR = "struct<result: map<string,string>>"
#: Fixed value: what stands before a molecular formula.
FORMULA = "분자식 "


def _present(text: Column) -> Column:
    return F.when(text != "", text)


def registry_hints(payloads: DataFrame) -> DataFrame:
    """name, entity_type, registry, accession, label, detail, error of stored registry answers.

    ``payloads``: name, entity_type, payload (the registry's JSON answer; for ClinVar the summary of
    the first record found) and error (of a call that failed, else null). Types without a registry
    give no row. An answer without a record is ``not_found``, one that isn't a JSON object ``unreadable``, and
    rows with an error have an empty accession and detail and the name as label.
    """
    rows = payloads.withColumn("registry", registry_for(F.col("entity_type"))).where("registry IS NOT NULL")
    text = lambda c: F.coalesce(c, F.lit(""))
    object_ = F.from_json("payload", "map<string,string>").isNotNull() & F.trim("payload").startswith("{")
    protein = F.get(F.from_json("payload", _UNIPROT)["results"], F.lit(0))
    compound = F.get(F.from_json("payload", _PUBCHEM)["PropertyTable"]["Properties"], F.lit(0))
    variants = F.from_json("payload", _CLINVAR)["result"]
    uid = F.get(F.from_json(F.element_at(variants, "uids"), "array<string>"), F.lit(0))
    variant = F.from_json(F.element_at(variants, uid), "struct<title: string, gene_name: array<string>>")
    gene_organism = F.regexp_replace(F.concat(text(F.get(protein["genes"], F.lit(0))["geneName"]["value"]), F.lit(" · "), text(protein["organism"]["scientificName"])), "^[ ·]+|[ ·]+$", "")
    formula = text(compound["MolecularFormula"])
    of = {
        "uniprot": (protein.isNotNull(), text(protein["primaryAccession"]), _present(protein["proteinDescription"]["recommendedName"]["fullName"]["value"]), gene_organism),
        "pubchem": (compound.isNotNull(), text(compound["CID"]), _present(compound["Title"]), F.when(formula != "", F.concat(F.lit(FORMULA), formula)).otherwise("")),
        "clinvar": (uid.isNotNull(), text(uid), _present(variant["title"]), text(F.array_join(F.slice(variant["gene_name"], 1, 2), " "))),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("registry") == name, parts[i]) for name, parts in of.items()])
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(object_, F.lit(False)), "unreadable").when(~F.coalesce(pick(0), F.lit(False)), "not_found")
    read = rows.select("name", "entity_type", "registry", failed.alias("failed"), pick(1).alias("a"), pick(2).alias("l"), pick(3).alias("d"))
    fine = F.col("failed").isNull()
    return read.select("name", "entity_type", "registry", F.when(fine, F.col("a")).otherwise("").alias("accession"), F.coalesce(F.when(fine, F.col("l")), "name").alias("label"), F.when(fine, F.col("d")).otherwise("").alias("detail"), F.col("failed").alias("error"))
