"""Hand-computed cases of single operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import community, graph, ledger, packs, quality, resolve, review, search
from stemma.sources import documents, papers, registry


def one(df):
    return df.first()[0]


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_normalize_name(spark):
    got = values(spark, T.normalize_name, ["Salt Sampler", "salt-sampler", "C", "C++", "IL-6", "Straße 12", None])
    assert got == ["saltsampler", "saltsampler", "c", "c++", "il-6", "strasse12", None]


def test_doi(spark):
    got = values(spark, T.normalize_doi, ["https://doi.org/10.1/AbC.", "doi:10.2/x", "11.1/x", None, " http://dx.doi.org/10.3/y,) "])
    assert got == ["10.1/abc", "10.2/x", None, None, "10.3/y"]


def test_cas(spark):
    assert values(spark, T.cas_valid, ["7732-18-5", "7732-18-4", "x", None]) == [True, False, False, False]


def test_excerpt(spark):
    df = spark.createDataFrame([("abcdefghij", 2, 4), ("abc", 2, 2), (None, 0, 1), ("abc", -5, 99)], "t string, a int, b int")
    got = [r[0] for r in df.select(T.span_excerpt(F.col("t"), F.col("a"), F.col("b"), 3)).collect()]
    assert got == ["ab>>>cd<<<efg", "", "", ">>>abc<<<"]


def test_fenced_block(spark):
    assert values(spark, T.fenced_block, ["x\n```json\n{}\n```y", "```\n\n```", "none"]) == ["{}", None, None]


def test_html():
    assert T.visible_text("<head><title>T</title></head><p>a <b>b</b></p><script>x</script><div>c</div>") == ("T", "a b\n\nc")


def test_jats():
    xml = "<article><front><abstract><p>A b.</p></abstract></front><body><p>C<xref>1</xref> d.</p></body><back><ref-list><p>no</p></ref-list></back></article>"
    assert T.jats_text(xml) == "A b.\n\nC d."
    floats = "<article><body><sec><title>S</title><p>x<label>1</label>y</p></sec><fig><caption><p>Shown  here.</p></caption></fig><table-wrap><td>cell</td><table-wrap-foot>no</table-wrap-foot></table-wrap><disp-formula>a=b</disp-formula><fn-group><fn><p>note</p></fn></fn-group></body><front><abstract>First.</abstract></front></article>"
    assert T.jats_text(floats) == "First.\n\nS\nxy\nShown here.cella=b"
    assert T.jats_text("<a") == T.jats_text(None) == ""


def test_surface_key(spark):
    assert values(spark, T.surface_key, ["  Ａbc  D\n", None]) == ["abc d", None]


def test_conformal(spark):
    assert quality.conformal_rank(19, 0.05) == 19 and quality.conformal_rank(18, 0.05) is None
    df = spark.createDataFrame([(0.02 + 0.04 * i,) for i in range(20)], "score double")
    row = quality.conformal_threshold(df, 0.1).first()
    assert row["n"] == 20 and row["threshold"] == pytest.approx(0.02 + 0.04 * 18)
    with pytest.raises(ValueError):
        quality.conformal_threshold(df, 1.0)


def test_isotonic():
    assert quality.isotonic_steps([(0.1, 1, 1), (0.2, 1, 0), (0.8, 1, 1)]) == [(0.1, 0.5), (0.8, 1.0)]
    rng = random.Random(3)
    for _ in range(100):
        fit = quality.isotonic_steps([(i, 1, rng.random()) for i in range(20)])
        assert all(a[1] < b[1] for a, b in zip(fit, fit[1:]))


def test_ece(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.1, 0), (0.1, 0)], "confidence double, label int")
    assert quality.ece(df).first()["ece"] == pytest.approx(0.25)


def test_prf(spark):
    t = lambda rows: spark.createDataFrame([(r,) for r in rows], "x string")
    r = quality.precision_recall(t(["a", "b", "c"]), t(["b", "c", "d"]), ["x"]).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["f1"] == pytest.approx(2 / 3)
    assert quality.precision_recall(t([]), t([]), ["x"]).first()["f1"] == 1
    assert quality.precision_recall(t(["a"]), t([]), ["x"]).first()["f1"] == 0


def test_bootstrap():
    low, high = quality.bootstrap_f1(20, 2, 2)
    assert 0 < low < 20 * 2 / 44 + 0.05 and low < high <= 1
    assert quality.bootstrap_f1(20, 2, 2) == (low, high)


def test_label_propagation_cases():
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    a, b = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    label = community.propagate(sorted(a + b), clique(a) + clique(b) + [("a0", "b0")])
    assert len(set(label.values())) == 1
    label = community.propagate(["a1", "a2", "a3", "b1", "b2", "lone"], [("a1", "a2"), ("a2", "a3"), ("b1", "b2")])
    assert label["lone"] == "lone" and label["a1"] == label["a3"] != label["b1"] == label["b2"]


GRAPH_NODES = [("a", "T", "A", "verified"), ("b", "T", "B", "verified"), ("c", "T", "C", "verified"), ("d", "T", "D", "proposed"), ("e", "T", "E", "rejected")]
GRAPH_EDGES = [("ab", "r", "a", "b", "verified", None), ("bc", "r", "b", "c", "verified", None), ("ac", "r", "a", "c", "verified", 1.0), ("cd", "r", "c", "d", "verified", None), ("ae", "r", "a", "e", "verified", None)]


@pytest.fixture(scope="module")
def tiny(spark):
    n = spark.createDataFrame(GRAPH_NODES, "id string, entity_type string, name string, status string")
    e = spark.createDataFrame(GRAPH_EDGES, "id string, relation_type string, src string, dst string, status string, invalidated_ts double")
    return n, e


def test_subgraph_and_path(tiny):
    n, e = tiny
    assert {r["id"] for r in graph.verified_subgraph(n, e).collect()} == {"ab", "bc"}
    path = graph.shortest_path(n, e, "a", "c").collect()
    assert [(r["step"], r["node_id"], r["edge_id"]) for r in path] == [(0, "a", None), (1, "b", "ab"), (2, "c", "bc")]
    assert graph.shortest_path(n, e, "a", "a").count() == 1
    assert graph.shortest_path(n, e, "a", "d").count() == 0
    assert graph.shortest_path(n, e, "a", "d", include_proposed=True).count() == 4


def test_traverse_limit_keeps_touched_edges(tiny):
    nodes, edges = graph.traverse(*tiny, ["a"], max_hops=2, limit=2)
    assert {(r["id"], r["hop"]) for r in nodes.collect()} == {("a", 0), ("b", 1)}
    nodes, edges = graph.traverse(*tiny, ["a"], max_hops=2)
    assert {(r["id"], r["hop"]) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["id"] for r in edges.collect()} == {"ab", "bc"}


def test_property_equals_is_typed(spark):
    df = spark.createDataFrame([('{"k":1}',), ('{"k":"1"}',), ('{"k":1.5}',), ("bad",), (None,)], "p string")
    assert [r[0] for r in df.select(graph.property_equals(F.col("p"), "k", 1)).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(graph.property_equals(F.col("p"), "k", "1")).collect()] == [False, True, False, False, False]


def test_review_pages_walk_everything(spark):
    n = spark.createDataFrame([(f"n_{i:04d}", "T", f"N{i}", "proposed", (i % 10) / 10 if i % 7 else None, float(i % 3)) for i in range(57)], "id string, entity_type string, name string, status string, confidence double, created_ts double")
    e = spark.createDataFrame([], "id string, relation_type string, src string, dst string, status string, confidence double, created_ts double, invalidated_ts double")
    r = spark.createDataFrame([], "kind string, item_id string, engine string, score double, created_ts double, seq long")
    for order in ("created", "confidence", "confidence_desc"):
        seen, cursor = [], None
        while True:
            page = review.review_queue(n, e, r, order, 20, cursor).orderBy("pos").collect()
            seen += [x["item_id"] for x in page]
            if len(page) < 20:
                break
            cursor = review.cursor_of(page[-1], order)
        assert len(seen) == 57 == len(set(seen))
    with pytest.raises(ValueError):
        review.review_queue(n, e, r, "created", 20, (1,))


def test_status_changes(tiny):
    n, e = tiny
    ids = e.where("id = 'cd'").select("id")
    n2, _ = review.approve_edges(n, e, ids, cascade=True)
    assert {r["id"]: r["status"] for r in n2.collect()}["d"] == "verified"
    back = {r["id"]: r["status"] for r in review.reopen(n, e, n.select("id")).collect()}
    assert back["a"] == "verified" and back["e"] == "verified" or back["e"] == "rejected"
    once = review.invalidate(e, e.select("id"), 5.0)
    assert {r["id"]: r["invalidated_ts"] for r in once.collect()}["ac"] == 1.0


def test_rrf_and_cosine(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "key string, rank int")
    got = {r["key"]: r["score"] for r in search.rrf([ranked([("a", 1), ("b", 2)]), ranked([("a", 1)])]).collect()}
    assert got["a"] == pytest.approx(1.0) and 0 < got["b"] < 1
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.0, 1.0])


def test_hash_vector():
    v = search.hash_vector("Salt Sampler")
    assert len(v) == 256 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    assert v == search.hash_vector("  salt   sampler ") and not any(search.hash_vector(""))


def test_expand_query():
    assert search.expand_query("SaltSampler") == ["Salt Sampler"]
    assert "riversluice" in [x.lower() for x in search.expand_query("River Sluice")]


def test_resolve_chains(spark):
    rows = [(1, "T", "alpha", ["beta"]), (2, "T", "beta", ["gamma"]), (3, "T", "gamma", []), (4, "T", "delta", [])]
    df = spark.createDataFrame(rows, "seq long, entity_type string, normalized_name string, alias_keys array<string>")
    got = {r["seq"]: r["node_key"] for r in resolve.resolve_sequentially(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_merge_guards(tiny):
    n, e = tiny
    with pytest.raises(ValueError):
        resolve.merge_nodes(n, e, "a", "a")
    with pytest.raises(ValueError):
        resolve.merge_nodes(n, e, "a", "e")
    n2, e2 = resolve.merge_nodes(n, e, "a", "b")
    got = {r["id"]: (r["src"], r["dst"], r["status"]) for r in e2.collect()}
    assert got["ab"] == ("a", "b", "rejected") and got["bc"] == ("a", "c", "verified")
    assert {r["id"]: r["review_note"] for r in n2.collect()}["b"] == "merged-into:a"


def test_candidates(spark):
    n = spark.createDataFrame([("1", "T", "saltsampler", "verified"), ("2", "T", "saltsamplers", "verified"), ("3", "T", "zebra", "verified")], "id string, entity_type string, normalized_name string, status string")
    a = spark.createDataFrame([("3", "stripes"), ("1", "stripes")], "node_id string, normalized_alias string")
    got = {(r["a"], r["b"]): r for r in resolve.scan_candidates(n, a).collect()}
    assert set(got) == {("1", "2"), ("1", "3")} and got[("1", "3")]["score"] == pytest.approx(0.95)
    assert len(got[("1", "2")]["reasons"]) == 2


def test_chunk_bounds():
    text = " ".join(f"w{i}" for i in range(9000))
    bounds = documents.chunk_bounds(text)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    assert all(b[0] < a[1] and b[0] > a[0] and b[1] - b[0] <= 12_000 for a, b in zip(bounds, bounds[1:]))
    assert documents.chunk_bounds("x" * 30_000)[-1][1] == 30_000
    assert documents.chunk_bounds("short") == [(0, 5)]


def test_collapse(spark):
    rows = [(1, "x", "long text", "10.1/a", "u1"), (2, "y", "text", "10.1/a", "u2"), (3, "y", "t", None, "u3")]
    df = spark.createDataFrame(rows, "arrival long, source string, text string, doi string, source_uri string")
    got = documents.collapse_duplicates(df, ["y", "x"]).collect()
    assert {r["arrival"] for r in got} == {1, 3}


def test_fan_out(spark):
    rows, failed = documents.fan_out({"a": spark.range(2), "b": ValueError("x"), "c": RuntimeError("y")})
    assert rows.count() == 2 and failed == [("b", "no_json"), ("c", "fetch_failed")]


@pytest.mark.parametrize(
    ("source", "payload", "want"),
    [
        ("crossref", '{"message":{"items":[{"DOI":"10.1/A","title":["T"],"abstract":"<p>x y</p>","type":"posted-content"}]}}', ("T\n\nx y", "10.1/a", "preprint")),
        ("openalex", '{"results":[{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/A","title":"T","type":"article","abstract_inverted_index":{"b":[1],"a":[0,2]}}]}', ("T\n\na b a", "10.1/a", "peer_reviewed")),
        ("semanticscholar", '{"data":[{"title":"T","abstract":"x","url":"u","externalIds":{"DOI":"10.1/A"},"publicationTypes":["Review"]}]}', ("T\n\nx", "10.1/a", "other")),
        ("europepmc", '{"resultList":{"result":[{"id":"1","source":"PPR","title":"T","abstractText":"x","doi":"10.1/A"}]}}', ("T\n\nx", "10.1/a", "preprint")),
        ("biorxiv", '{"collection":[{"doi":"10.1/A","title":"T","abstract":"x"}]}', ("T\n\nx", "10.1/a", "preprint")),
        ("clinicaltrials", '{"studies":[{"protocolSection":{"identificationModule":{"nctId":"NCT1","briefTitle":"T"},"descriptionModule":{"briefSummary":"x"}}}]}', ("T\n\nx", None, "registration")),
        ("springer", '{"records":[{"title":"T","abstract":"x","doi":"10.1/A","url":[{"value":"u"}]}]}', ("T\n\nx", "10.1/a", "peer_reviewed")),
        ("elsevier", '{"search-results":{"entry":[{"dc:title":"T","dc:description":"x","prism:doi":"10.1/A","prism:url":"u"},{"error":"none"}]}}', ("T\n\nx", "10.1/a", "peer_reviewed")),
        ("core", '{"results":[{"id":"9","title":"T","abstract":"x","doi":"10.1/A"}]}', ("T\n\nx", "10.1/a", "unknown")),
        ("searxng", '{"results":[{"url":"u","title":"T","content":"x"},{"url":"v","title":"U"}]}', ("T\n\nx", None, "unknown")),
        ("arxiv", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>T</title><summary>x</summary></entry><entry><id> </id><title>no</title></entry></feed>', ("T\n\nx", None, "preprint")),
        ("pubmed", '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>x</AbstractText><AbstractText>y</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/A</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>', ("T\n\nx y", "10.1/a", "peer_reviewed")),
    ],
)
def test_parsers(spark, source, payload, want):
    rows = papers.PARSERS[source](spark.createDataFrame([(payload,), ("not a payload",)], "payload string")).collect()
    assert [(r["text"], r["doi"], r["evidence_grade"]) for r in rows] == [want]


def test_gates(spark):
    assert values(spark, lambda c: papers.allowed(c, ["a.org"]), ["https://a.org/x", "http://a.org", "https://b.a.org", None, "%"]) == [True, False, False, False, False]
    assert values(spark, papers.query_ok, ["rna", "", "x" * 201, "a://b", "a\tb"]) == [True, False, False, False, False]


def test_registry(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "surface string, code string")
    assert registry.build_registry(rows).count() == 2
    with pytest.raises(Exception, match="conflicting"):
        registry.build_registry(rows.union(spark.createDataFrame([("a", "9")]))).collect()
    syn = spark.createDataFrame([(1, "7732-18-5"), (1, "Water"), (1, "WATER "), (3, "no number"), (4, "7732-18-6")], "cid long, surface string")
    assert {tuple(r) for r in registry.import_pubchem(syn).collect()} == {("7732-18-5", "7732-18-5"), ("water", "7732-18-5")}
    more = lambda *rows: syn.union(spark.createDataFrame(list(rows), "cid long, surface string"))
    for rows, said in (([(1, "50-00-0")], "several CAS"), ([(5, "50-00-0"), (5, "water")], "conflicting"), ([(1, " ")], "without letters")):
        with pytest.raises(Exception, match=said):
            registry.import_pubchem(more(*rows)).collect()


def test_pubchem_dump(spark, tmp_path):
    import gzip

    good = tmp_path / "dump.gz"
    good.write_bytes(gzip.compress(b"1\t7732-18-5\n1\tWater\n2\tother\n"))
    assert {tuple(r) for r in registry.import_pubchem(registry.read_pubchem(spark, str(good))).collect()} == {("7732-18-5", "7732-18-5"), ("water", "7732-18-5")}
    for line, said in (("1 water", "not CID"), ("x\twater", "number"), ("1\t", "empty"), ("1\ta\tb", "not CID")):
        bad = tmp_path / f"bad{len(said)}{len(line)}.txt"
        bad.write_text(line + "\n")
        with pytest.raises(Exception, match=said):
            registry.read_pubchem(spark, str(bad)).collect()


def test_normalize_proposals(spark):
    p = spark.createDataFrame([("1", "Gray mould", ["BOTCIN"], {"eppo": "WRONG"}), ("2", "none", [], {})], "id string, name string, aliases array<string>, properties map<string,string>")
    reg = spark.createDataFrame([("botcin", "BOTRCI")], "surface string, code string")
    got = {r["id"]: r["properties"] for r in registry.normalize_proposals(p, reg, "eppo").collect()}
    assert got["1"] == {"eppo": "BOTRCI", "eppo_dropped": "WRONG"} and got["2"] == {"eppo_missing": "true"}


def test_resource(spark):
    df = spark.createDataFrame([("TP53", '{"hits":[{"_id":"7157","symbol":"tp53","name":"tumor protein"},{"_id":"1","symbol":"TP53BP1","name":"n"}]}')], "name string, payload string")
    assert [tuple(r) for r in registry.parse_resource(df, "mygene").collect()] == [("TP53", "7157", "tumor protein")]


def test_pack_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", 1), ("b", 2)], "id string, k int")
    made = packs.build_pack(spark, str(tmp_path), "p1", {"nodes": n}, 1.0)
    again = packs.build_pack(spark, str(tmp_path), "p2", {"nodes": n.orderBy(F.desc("id")).repartition(3)}, 2.0)
    assert made["content_hash"] == again["content_hash"] and made["counts"] == {"nodes": 2}
    assert [r["name"] for r in packs.list_packs(spark, str(tmp_path)).collect()] == ["p2", "p1"]
    with pytest.raises(ValueError):
        packs.build_pack(spark, str(tmp_path), "../x", {"nodes": n}, 1.0)
    with pytest.raises(Exception):
        packs.build_pack(spark, str(tmp_path), "p1", {"nodes": n}, 1.0)


def test_annotations(spark):
    old = spark.createDataFrame([("n", "r", "a", "pending"), ("n", "q", "a", "accepted")], "node_id string, resource string, facts string, status string")
    new = spark.createDataFrame([("n", "r", "b"), ("n", "q", "b"), ("m", "r", "c")], "node_id string, resource string, facts string")
    got = {(r["node_id"], r["resource"]): (r["facts"], r["status"]) for r in ledger.upsert_annotations(old, new).collect()}
    assert got == {("n", "r"): ("b", "pending"), ("n", "q"): ("a", "accepted"), ("m", "r"): ("c", "pending")}


def test_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"engine":"a","elapsed":1.5}\nbroken\n{"engine":"a","elapsed":2}\n')
    row = ledger.cost_summary(ledger.read_log(spark, str(tmp_path))).first()
    assert (row["engine"], row["calls"], row["elapsed"]) == ("a", 2, 3.5)


def test_stream_is_idempotent(spark, tmp_path):
    from stemma.streaming.ingest import ingest_stream

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    docs([(1, "a", "s"), (2, "a", "s"), (3, "b", "s")]).write.parquet(src)
    ingest_stream(spark, src, out, ck).awaitTermination()
    docs([(4, "b", "s"), (5, "c", "s")]).write.mode("append").parquet(src)
    ingest_stream(spark, src, out, ck).awaitTermination()
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (3, "b"), (5, "c")]


def test_references_without_a_semicolon_are_text():
    page = "<title>A&amp;&amp</title><h1>A&amp;&amp</h1><p>&lt;b&gt; &#65; &copy=1 &ampx; &nosuch;</p>"
    assert T.visible_text(page) == ("A&&amp", "A&&amp\n\n<b> A &copy=1 &ampx; &nosuch;")


def test_web_documents_keep_cut_references(spark):
    from stemma.sources.documents import read_pages

    pages = spark.createDataFrame([("https://a.org/1", "<title>A &amp</title><p>x</p>")], "url string, html string")
    assert [tuple(r) for r in read_pages(pages, ["a.org"]).select("title", "text").collect()] == [("A &amp", "x")]
