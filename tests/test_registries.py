"""Registry answers, modes of action and proposals normalized by them; lineage and pages in odd cases; predicted steps."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import graph, quality, review
from stemma.plans.shipping import ship
from stemma.sources import registry

WATER, ETHANOL = "7732-18-5", "64-17-5"
PROPOSALS = "id string, entity_type string, name string, aliases array<string>, properties map<string,string>"


def test_moa_registry(spark):
    of = lambda *rows: registry.moa_registry(spark.createDataFrame(rows, "cas_number string, scheme string, code string"))
    assert sorted(map(tuple, of((WATER, "frac", "M1"), (f" {WATER} ", "FRAC", "M1"), (ETHANOL, "IRAC", "4A")).collect())) == [(ETHANOL, "IRAC", "4A"), (WATER, "FRAC", "M1")]
    assert of((WATER, "FRAC", "1")).where("false").count() == 0
    for bad in [("7732-18-4", "FRAC", "1"), (WATER, "XRAC", "1"), (WATER, "FRAC", " "), (None, "FRAC", "1"), (WATER, None, "1"), (WATER, "FRAC", None)]:
        with pytest.raises(Exception, match="invalid mode of action"):
            of(bad).collect()
    with pytest.raises(Exception, match="conflicting modes"):
        of((WATER, "FRAC", "1"), (WATER, "FRAC", "2")).collect()


def test_normalize_domain(spark):
    ship(spark)
    rows = [
        ("1", "ActiveIngredient", "Ｗater", [], {"cas_number": "X", "moa_code": "made up", "other": "o"}),
        ("2", "ActiveIngredient", "unknown", ["nor", "AQUA", "water"], {"cas_number": WATER, "normalization": "no_cas_match", "cas_number_dropped": "old"}),
        ("3", "ActiveIngredient", "unknown", None, {"cas_number": "X", "cas_matched_surface": "s"}),
        ("4", "ActiveIngredient", None, None, None),
        ("5", "Crop", "water", [], {"cas_number": "kept"}),
        ("6", None, "water", None, None),
    ]
    p = spark.createDataFrame(rows, PROPOSALS)
    known = spark.createDataFrame([("water", WATER), ("aqua", WATER)], "surface string, code string")
    moa = spark.createDataFrame([(WATER, "FRAC", "M1")], "cas_number string, scheme string, code string")
    by = lambda df: {r["id"]: r["properties"] for r in df.collect()}
    got = by(registry.normalize_domain(p, known, "cas", moa))
    action = {"moa_scheme": "FRAC", "moa_code": "M1"}
    assert got == {
        "1": {"other": "o", "cas_number": WATER, "cas_matched_surface": "Ｗater", "cas_number_dropped": "X"} | action,
        "2": {"cas_number": WATER, "cas_matched_surface": "AQUA"} | action,
        "3": {"cas_number_dropped": "X", "normalization": "no_cas_match"},
        "4": {"normalization": "no_cas_match"},
        "5": {"cas_number": "kept"},
        "6": None,
    }
    assert by(registry.normalize_domain(p, known, "cas"))["1"].keys() == {"other", "cas_number", "cas_matched_surface", "cas_number_dropped"}
    absent = by(registry.normalize_domain(p, None, "cas"))
    assert absent == {"1": {"other": "o"}, "2": {}, "3": {}, "4": {}, "5": {"cas_number": "kept"}, "6": None}
    crop = by(registry.normalize_domain(p, known, "eppo"))
    assert crop["5"] == {"cas_number": "kept", "eppo_code": WATER, "eppo_matched_surface": "water"} and crop["1"] == rows[0][4]
    assert registry.normalize_domain(p.limit(0), known.limit(0), "eppo").count() == 0


def test_hints(spark):
    uniprot = '{"results":[{"primaryAccession":"P1","genes":[{"geneName":{"value":"TP53"}}],"organism":{"scientificName":"Homo"}}]}'
    clinvar = '{"result":{"uids":["7","8"],"7":{"title":"v","gene_name":["A","B","C"],"more":{"x":[1]}},"8":{}}}'
    rows = [
        ("a", "Protein", uniprot, None),
        ("b", "Variant", clinvar, None),
        ("c", "Drug", '{"PropertyTable":{"Properties":[{"CID":12,"MolecularFormula":"H2O"}]}}', None),
        ("d", "Drug", '{"PropertyTable":{}}', None),
        ("e", "Gene", None, None),
        ("f", "Gene", "[]", None),
        ("g", "Gene", uniprot, "timeout"),
        ("h", "City", "{}", None),
        ("i", None, "{}", None),
        ("j", "Variant", '{"result":{"uids":["9"]}}', None),
    ]
    got = registry.registry_hints(spark.createDataFrame(rows, "name string, entity_type string, payload string, error string")).drop("entity_type")
    assert sorted(map(tuple, got.collect())) == [
        ("a", "uniprot", "P1", "a", "TP53 · Homo", None),
        ("b", "clinvar", "7", "v", "A B", None),
        ("c", "pubchem", "12", "c", "분자식 H2O", None),
        ("d", "pubchem", "", "d", "", "not_found"),
        ("e", "uniprot", "", "e", "", "unreadable"),
        ("f", "uniprot", "", "f", "", "unreadable"),
        ("g", "uniprot", "", "g", "", "timeout"),
        ("j", "clinvar", "9", "j", "", None),
    ]


def test_provenance_pages_hold_the_first(spark):
    rnd = random.Random(5)
    cited = [("node", "hot", rnd.randrange(500), rnd.randrange(9), 9) for _ in range(3000)] + [("node", "cold", 1, 2, 3), ("edge", "hot", 1, 2, 3)]
    c = spark.createDataFrame(cited, "kind string, item_id string, doc_id long, start int, end int")
    items = spark.createDataFrame([("node", "hot"), ("node", "cold"), ("node", "none")], "kind string, item_id string")
    docs = spark.createDataFrame([(i, f"s{i}") for i in range(0, 500, 2)], "doc_id long, source string")
    reviews = spark.createDataFrame([], "kind string, item_id string, engine string, score double, created_ts double, seq long")
    got = {r["item_id"]: r for r in graph.provenance(items, c, docs, reviews, page=7).collect()}
    first = sorted(x[2:] for x in cited if x[:2] == ("node", "hot"))[:7]
    assert [(x["doc_id"], x["start"], x["end"]) for x in got["hot"]["citations"]] == first and got["hot"]["n_citations"] == 3000
    assert [x["source"] for x in got["hot"]["citations"]] == [None if d % 2 else f"s{d}" for d, *_ in first]
    assert (got["none"]["citations"], got["none"]["n_citations"], got["cold"]["n_citations"]) == (None, 0, 1)


def test_queue_properties_without_columns(spark):
    page = spark.createDataFrame([("node", "a"), ("edge", "a")], "kind string, item_id string")
    n = spark.createDataFrame([("a", {"k": "v"}), ("b", {"k": "w"})], "id string, properties map<string,string>")
    got = {r["kind"]: (r["aliases"], r["properties"]) for r in review.with_properties(page, n, n.select("id")).collect()}
    assert got == {"node": (None, {"k": "v"}), "edge": (None, None)}


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_predicted_steps(spark, partitions):
    rnd = random.Random(partitions)
    at = sorted({round(rnd.random(), 3) for _ in range(200)})
    value = sorted(rnd.random() for _ in at)
    xs = [0.5] * 50 + [round(rnd.uniform(-0.2, 1.2), 3) for _ in range(400)] + [None, float("nan"), *at[:5]]
    rows = spark.createDataFrame(list(enumerate(xs)), "k int, confidence double")
    curve = spark.createDataFrame(list(zip(at, value)), "boundary double, value double")
    got = {r["k"]: r["calibrated"] for r in quality.isotonic_predict(rows, curve, partitions=partitions).collect()}
    want = lambda x: None if x is None else value[-1] if x != x else value[max(bisect.bisect_right(at, x) - 1, 0)]
    assert got == {k: want(x) for k, x in enumerate(xs)}
    none = quality.isotonic_predict(rows, curve.limit(0), partitions=partitions)
    assert none.count() == len(xs) and none.where("calibrated IS NOT NULL").isEmpty()
    assert quality.isotonic_predict(rows.withColumn("calibrated", F.lit(9.0)), curve).columns == ["k", "confidence", "calibrated"]
