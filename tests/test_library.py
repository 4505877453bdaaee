"""Catalogue, alignment, citations, sources, publication, tables of contents, redirects and streams on small fixtures."""

import json
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from loculus.functions import urn as U
from loculus.operators import align, catalog, citation, endpoints, overlap, publish, ranking, redirect, search, search_index, toc, tokens
from loculus.sources import commentary, documents
from loculus.streaming import arrivals


def test_kinds_and_preferred(spark):
    rows = [("w", "1st-grc1", "grc", None, False, 0), ("w", "pub-grc1", "grc", None, False, 1), ("w", "pub-grc2", "grc", None, False, 2), ("w", "pub-eng2", "grc", None, False, 3), ("w", "pub-eng1", "eng", "urn:x", False, 4), ("w", "exp-grc9", "grc", None, True, 5)]
    v = spark.createDataFrame(rows, "work string, version string, language string, about string, experimental boolean, pos int")
    v = v.withColumn("kind", catalog.version_kind(F.lit(None).cast("string"), F.col("about"), F.col("version"), F.col("language"), F.lit("grc"))).withColumn("label", F.col("version"))
    chosen = catalog.with_preferred(v, ["work"], "pos")
    got = {r.version: (r.kind, r.preferred) for r in chosen.collect()}
    assert got == {"1st-grc1": ("edition", True), "pub-grc1": ("edition", False), "pub-grc2": ("edition", True), "pub-eng2": ("translation", True), "pub-eng1": ("commentary", True), "exp-grc9": ("edition", False)}
    forced = catalog.with_preferred(v, ["work"], "pos", F.col("version") == "pub-grc1")
    assert [r.version for r in forced.where("preferred").collect()] == ["pub-grc1"]
    shown = v.where("kind = 'edition'").orderBy(*catalog.display_keys()).select("version").collect()
    assert [r[0] for r in shown] == ["pub-grc1", "pub-grc2", "1st-grc1", "exp-grc9"]
    best = {r.family: r.version for r in catalog.family_best(chosen, ["work"]).collect()}
    assert best["pub-grc"] == "pub-grc2" and best["pub-eng"] == "pub-eng2"
    order = catalog.work_orders(chosen, ["work"]).orderBy("place").select("version").collect()
    assert [r[0] for r in order][:3] == ["pub-grc2", "1st-grc1", "pub-grc1"]


def test_small_lookups(spark):
    e = spark.createDataFrame([([("Ann", "translator"), (" ", "editor"), ("Bob", "scribe")],)], "e array<struct<name:string,role:string>>")
    assert e.select(catalog.editors_shown(F.col("e"))).first()[0] == "Ann (Translator), ed. Bob"
    one = spark.range(1)
    assert one.select(catalog.licence(F.lit(""), F.lit("free"), F.lit("r"), {"r": "x"})).first()[0] == "free"
    assert one.select(catalog.licence(F.lit(None).cast("string"), F.lit(""), F.lit("r"), {"r": "x"})).first()[0] == "x"
    assert one.select(catalog.source_url(F.lit("r"), F.lit("a.xml"), {"r": "http://h/r"}), catalog.source_url(F.lit("q"), F.lit(""), {"r": "h"})).first() == ("http://h/r/a.xml", None)
    assert one.select(catalog.badge(F.lit("a.b.pub-grc1"), {"pub-": "House"}), catalog.badge(F.lit("x"), {"pub-": "House"})).first() == ("House", None)
    assert one.select(catalog.commentator(F.lit("urn:g"), F.lit("urn:g.w"), F.lit("N")), catalog.commentator(F.lit("urn:g"), F.lit("urn:h.w"), F.lit("N"))).first() == ("", "N")
    titles = F.create_map(F.lit("lat"), F.lit("L"), F.lit("eng"), F.lit(""))
    assert one.select(catalog.work_title(titles, F.lit("id"))).first()[0] == "L"
    groups = spark.createDataFrame([("urn:cts:a:g1",), ("urn:cts:b:g1",), ("urn:cts:a:g9",)], "urn string")
    names = spark.createDataFrame([("urn:cts:a:g1", "lat", "Latina"), ("urn:cts:a:g1", "eng", "English")], "urn string, lang string, name string")
    assert {r.urn: r.name for r in catalog.group_names(groups, names).collect()} == {"urn:cts:a:g1": "English", "urn:cts:b:g1": "English", "urn:cts:a:g9": "g9"}


def chunk_frame(spark, starts, by=1):
    return spark.createDataFrame([(by, s, k, str(s)) for k, s in enumerate(starts)], "v int, start array<bigint>, pos int, chunk string")


@pytest.mark.parametrize(("starts", "key", "floor", "near"), [([[1], [94], [141], [497]], [94], "[94]", "[94]"), ([[1], [94], [141], [497]], [200], "[141]", "[141]"), ([[1], [94]], [0], None, "[1]"), ([[1], [90], [94], [95], [100]], [92], "[90]", "[90]"), ([[1, 49], [1, 50], [1, 51]], [1, 50, 9], "[1, 50]", "[1, 50]")])
def test_floor_and_nearest(spark, starts, key, floor, near):
    probe = spark.createDataFrame([(1, key)], "v int, key array<bigint>")
    chunks = chunk_frame(spark, starts)
    assert align.floor_join(probe, chunks, ["v"], "key", "start", F.col("chunk"), "pos").first().floor == floor
    assert align.nearest_join(probe, chunks, ["v"], "key", "start", F.col("chunk"), "pos").first().nearest == near


def test_leaf_alignment_and_prefix_floor(spark):
    chunks = chunk_frame(spark, [[4], [5, 1], [5, 2], [5, 3], [6]])
    base = spark.createDataFrame([(1, [5], [5])], "v int, low array<bigint>, high array<bigint>")
    got = align.align_siblings(base, chunks, ["v"], "low", "high", "start", "chunk", "pos").collect()
    assert sorted(r.aligned for r in got) == ["[5, 1]", "[5, 2]", "[5, 3]"]
    probe = spark.createDataFrame([(1, [5]), (1, [7]), (1, [0])], "v int, key array<bigint>")
    landed = align.prefix_floor_join(probe, chunks, ["v"], "key", "start", F.col("chunk"), "pos").collect()
    assert sorted(r.landing for r in landed) == ["[4]", "[5, 1]", "[6]"]


def test_citations(spark):
    records = spark.createDataFrame([("a1", "Thucydides", ["Thuc.", "T."], "Hist.", [("w1", "History", ["Hist."])]), ("a2", "Tacitus", ["Tac.", "T."], None, [("w2", "Annals", ["Ann."]), ("w3", "Histories", ["Hist."])]), ("urn:cts:zz:1", "Twin", ["Thuc."], None, [("w1", "History", ["Hist."])]), ("a3", "Nobody", ["N."], None, [("w9", "Lost", [])])], "author string, name string, name_abbrevs array<string>, default_abbrev string, works array<struct<work_urn:string,title:string,title_abbrevs:array<string>>>")
    deployed = spark.createDataFrame([("w1",), ("w2",), ("w3",)], "work_urn string")
    authors, works = citation.gazetteer_tables(records, deployed, "zz")
    texts = [("Thuc. 5.4", "resolved", "w1", "5.4"), ("Tac. Ann. 1.2-3", "resolved", "w2", "1.2"), ("Tac. 3", "choose-work", None, None), ("T. Hist. 3", "ambiguous", None, None), ("T. 9", "resolved", "w1", "9"), ("N. 1", "not-found", None, None), ("  ", "not-found", None, None)]
    got = citation.match_citations(spark.createDataFrame([(k, t[0]) for k, t in enumerate(texts)], "query_id int, text string"), authors, works)
    assert [(r.kind, r.work_urn, r.passage) for r in got.orderBy("query_id").collect()] == [t[1:] for t in texts]


XML = b"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body><div n="urn:cts:g:a.b.c" type="edition">
<div type="book" n="1"><div type="section" n="1">one <w xml:id="w1">two</w></div><div type="section" n="2" corresp="urn:cts:g:x.y:3">three</div></div>
<div type="strophe" n="1"><l n="7">seven</l></div></div></body></text></TEI>"""


def test_documents(spark, tmp_path):
    (tmp_path / "corp" / "r1" / "data" / "a").mkdir(parents=True)
    (tmp_path / "corp" / "r2").mkdir()
    (tmp_path / "corp" / "r1" / "data" / "a" / "a.b.c.xml").write_bytes(XML)
    (tmp_path / "corp" / "r1" / "data" / "__cts__.xml").write_bytes(b"<x/>")
    (tmp_path / "corp" / "r1" / "readme.xml").write_bytes(XML)
    (tmp_path / "corp" / "r2" / "broken.xml").write_bytes(b"<TEI><body>")
    found = documents.find_documents(spark, str(tmp_path / "corp")).withColumn("urn", documents.document_urn(F.col("content"))).withColumn("doc", F.col("rel_path"))
    assert sorted((r.repo, r.rel_path, r.urn) for r in found.collect()) == [("r1", "data/a/a.b.c.xml", "urn:cts:g:a.b.c"), ("r2", "broken.xml", None)]
    nodes = documents.parse_documents(found)
    leaves = overlap.citable_leaves(nodes.where("status = 'ok'"))
    assert sorted(r.n for r in leaves.collect()) == ["1", "2", "7"]
    status = documents.compile_status(found, spark.createDataFrame([], "doc string"), nodes)
    assert {r.doc: r.status for r in status.collect()} == {"data/a/a.b.c.xml": "ok", "broken.xml": "failed"}


def test_sidecars(spark):
    plain = json.dumps({"urn": "u", "tokens": [{"text": "a", "urn": "u@a[1]", "whitespace": True, "start_char": 0, "end_char": 1, "extra": 1}]}).encode()
    packed = zstandard.ZstdCompressor(level=19).compress(plain)
    frame = lambda rows: spark.createDataFrame(rows, "chunk string, content binary")
    chunks = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",)], "chunk string")
    got = documents.token_sidecars(chunks, frame([("1", packed)]), frame([("1", plain), ("2", packed), ("5", b"junk")]), frame([("2", plain), ("3", plain)]))
    assert sorted((r.chunk, r.origin, len(r.tokens) if r.tokens else 0) for r in got.collect()) == [("1", "outer", 1), ("2", "beside", 1), ("3", "plain", 1), ("4", None, 0), ("5", "beside", 0)]
    index = spark.createDataFrame([("v", '{"chunks":[{"cts_urn":"u:1","file":"1.xml"},{"cts_urn":"u:2","file":"2.xml"}]}'), ("w", None)], "version string, json string")
    assert [(r.pos, r.file) for r in documents.chunk_index(index).orderBy("pos").collect()] == [(0, "1.xml"), (1, "2.xml")]
    meta = documents.version_metadata(spark.createDataFrame([("v", '{"document":{"language":"grc","editors":[{"name":"A"}]}}')], "version string, json string")).first()
    assert (meta.language, meta.chunk_unit, meta.editors[0].name) == ("grc", "", "A")


MARKDOWN = """---
title: Notes
authors:
  - Ann Author
  - Bob Writer
---
## Scroll 1

---
@urn:cts:g:a.b:1.1
:subject: place
:keyword: x y

subject heading(s): hills
Body with ![pic](/i/p.png).
---
not anchored
---
@urn:cts:g:a.b:1.2-1.4

Second.
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "paus.md").write_text(MARKDOWN)
    (tmp_path / "one.md").write_text("---\nauthor: Solo\nshortname: S\n---\n@urn:cts:g:c.d:5\nText\n")
    rows = {(r.work_urn, r.citation): r for r in commentary.entries(commentary.read_markdown(spark, str(tmp_path)), F.lit("http://site")).collect()}
    first, second, third = rows[("urn:cts:g:a.b", "1.1")], rows[("urn:cts:g:a.b", "1.2-1.4")], rows[("urn:cts:g:c.d", "5")]
    assert len(rows) == 3 and first.authors == ["Ann Author", "Bob Writer"] and first.section == second.section == "Scroll 1"
    assert first.metadata == {"subject": "place", "keyword": "x y"} and first.body == "subject heading(s): hills\nBody with ![pic](http://site/i/p.png)."
    assert second.body == "Second." and first.source_label == "paus" and third.authors == ["Solo"] and third.source_label == "S" and third.section is None


def test_publication(spark, tmp_path):
    files = spark.createDataFrame([("x/one.xml", "urn:cts:g:a.b.c"), ("y/a.b.c.xml", "urn:cts:g:a.b.c"), ("b.xml", "other"), ("c.xml", None), ("d.xml", None)], "path string, urn string")
    assert sorted(r.path for r in publish.keep_canonical(files).collect()) == ["b.xml", "c.xml", "d.xml", "y/a.b.c.xml"]
    urls = spark.range(200).select(F.concat(F.lit("/u/"), "id").alias("url"))
    assert urls.withColumn("s", publish.crc_shard(F.col("url"), 5)).groupBy("s").count().agg(F.sum("count")).first()[0] == 200
    part = lambda k, v, s=5: spark.createDataFrame([(k, s, "w", "v1", v)], "ordinal int, schema_version int, work_urn string, version string, title string")
    assert publish.merge_manifests(part(0, "a").union(part(1, "b"))).first().title == "b"
    with pytest.raises(ValueError, match="schema version 4"):
        publish.merge_manifests(part(0, "a", 4))
    root = str(tmp_path)
    tokens = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk string, token string")
    assert publish.token_sidecars(tokens.where("chunk = '1'"), f"{root}/t", "chunk") == 1
    assert publish.token_sidecars(tokens, f"{root}/t", "chunk") == 1 and spark.read.parquet(f"{root}/t").count() == 2


def test_toc_and_redirects(spark):
    rows = [("d", 1, None, 0, "u:1", True, None), ("d", 2, 1, 1, "u:1.1", True, "chapter"), ("d", 3, None, 2, "u:2", False, None), ("d", 4, 3, 3, "u:2.1", False, None)]
    nodes = spark.createDataFrame(rows, "doc string, node int, parent int, pos int, urn string, has_scheme boolean, scheme string")
    assert {r.node: r.target for r in toc.linked_entries(nodes, "card").collect()} == {1: None, 2: "chapter", 3: None, 4: "card"}
    assert sorted((r.node, r.steps) for r in toc.opened_path(toc.tree_numbers(nodes), "u:2.1").collect()) == [(3, 1), (4, 0)]
    asked = [("/hop//text?doc=old:text:1999.01.0133:book=1", "/new/a.b.pub-grc2"), ("/texts/urn:cts:g:a.b.pub-grc1:1.1", "/new/a.b.pub-grc2"), ("http://h/x?urn=urn%3Acts%3Ag%3Aa.b", "/first"), ("/citations/urn:cts:g:a.b.pub-ger1", None), ("/about", None)]
    found = redirect.extract_identifiers(spark.createDataFrame([a[:1] for a in asked], "request string"), "old:text:")
    table = lambda rows, s: spark.createDataFrame(rows, s)
    got = redirect.resolve(found, table([("1999.01.0133", "urn:cts:g:a.b.pub-grc2")], "text_id string, urn string"), table([("urn:cts:g:a.b.pub-grc2", "/new/a.b.pub-grc2")], "urn string, href string"), table([("urn:cts:g:a.b.pub-grc", "/new/a.b.pub-grc2")], "family string, href string"), table([("urn:cts:g:a.b", "/first")], "work_urn string, href string"))
    assert {r.request: r.href for r in got.collect()} == dict(asked)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "2024-01-01 00:00:00", "a"), ("u1", "2024-01-01 00:01:00", "a"), ("u2", "2024-01-01 00:02:00", "b")], "urn string, at string, kind string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = arrivals.first_of_each(arrivals.arriving(spark, str(tmp_path / "in"), rows.schema), "urn", "at")
    arrivals.keep_up(stream, str(tmp_path / "out"), str(tmp_path / "state"), "kind").awaitTermination(120)
    assert sorted(r.urn for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]


def test_crc_shards(spark):
    urls = [f"/u/{k}/é" for k in range(50)]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", publish.crc_shard(F.col("url"), 7).alias("s")).collect()
    assert {r.url: r.s for r in got} == {u: zlib.crc32(u.encode()) % 7 for u in urls}


def test_sources_and_manifests(spark, tmp_path):
    rows = [("v", '{"document":{"title":"T","source_repo":"old"},"chunk_unit":"line"}', "repo", "data/x.xml"), ("w", '{"document":null}', "repo", "")]
    got = publish.record_source(spark.createDataFrame(rows, "version string, json string, source_repo string, source_path string"))
    assert {r.version: dict(r.document) for r in got.collect()} == {"v": {"title": "T", "source_repo": "repo", "source_path": "data/x.xml"}, "w": {"source_repo": "repo"}}
    part = lambda k: spark.createDataFrame([("w", f"v{k}", f"label{k}"), ("w", "v9", f"label{k}")], "work_urn string, version string, label string")
    paths = [publish.write_manifest(part(k), f"{tmp_path}/m{k}", f"digest{k}") for k in range(2)]
    merged = publish.merge_manifests(publish.read_manifests(spark, *paths))
    assert {r.version: r.label for r in merged.collect()} == {"v0": "label0", "v1": "label1", "v9": "label1"}
    assert publish.check_shards([1, 0, 2], 3) == [0, 1, 2] and publish.check_shards([0], None) == [0]
    for shards, published in (([0, 2], 2), ([0, 1], 3)):
        with pytest.raises(ValueError, match="shards"):
            publish.check_shards(shards, published)
    outcome = lambda *s: publish.tokenizing_outcome(spark.createDataFrame([(x,) for x in s], "status string"))
    assert outcome("generated", "failed", "generated") == {"generated": 2, "skipped": 0, "failed": 1}
    with pytest.raises(ConnectionError, match="1 chunks"):
        outcome("generated", "unreachable")


def test_chunk_text_and_files(spark):
    good = b'<chunk cts_urn="u:1"><elements><p>one <note>aside</note>two<b> three</b> four</p></elements></chunk>'
    rows = [("a", good), ("b", b'<chunk cts_urn="u:2"/>'), ("c", b"<broken")]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k string, c binary").select("k", documents.chunk_text("c").alias("t")).collect()}
    assert (got["a"].urn, got["a"].text, got["a"].error) == ("u:1", "one two three four", None)
    assert got["b"].error == "no content element" and got["c"].error and got["c"].text is None
    index = spark.createDataFrame([("v", "g/v", '{"chunks":[{"cts_urn":"u:1","file":"1.xml"},{"cts_urn":"u:2","file":"2.xml"}]}')], "version string, folder string, json string")
    assert [(r.pos, r.file) for r in documents.chunk_files(index, spark.createDataFrame([("g/v/2.xml",)], "path string")).collect()] == [(1, "g/v/2.xml")]
    files = spark.createDataFrame([("b", "x.xml"), ("a", "data/x.xml")], "repo string, rel_path string")
    assert [tuple(r) for r in documents.corpora(files).collect()] == [("a", "a/data"), ("b", "b")]
    nodes = spark.createDataFrame([("d", [0, 2], "licence", " CC "), ("d", [0, 1], "publisher", "P"), ("d", [0, 3], "publisher", "Q")], "doc string, path array<int>, tag string, text string")
    assert documents.publication_info(nodes).first()[1:] == ("P", "CC", None)


def test_labels_and_paths(spark):
    one = spark.range(1)
    lit = lambda *x: [F.lit(v).cast("string") for v in x]
    assert one.select(search.work_label(*lit("A", "T", "u")), search.work_label(*lit(None, "", "u")), search.result_label(*lit("T", "grc", "A", ""))).first() == ("A, T", "u", "T (grc) — A")
    works = spark.createDataFrame([(1, 5), (2, 3)], "doc_id long, n long")
    assert [search.selected_works(works, k).count() for k in (None, 2, 9)] == [2, 1, 2]
    assert one.select(endpoints.hit_url(*lit("urn:cts:g:a.b.c", "1", "u:1@ab c[1]é"))).first()[0] == "/urn:cts:g:a.b.c:1/?token=u%3A1%40ab%20c%5B1%5D%C3%A9"
    assert one.select(U.chunk_folder(*lit("urn:cts:g:a.b.c", "card")), U.chunk_file(*lit("urn:cts:g:a.b.c", "3")), U.manifest_file(*lit("urn:cts:g:a.b.c")), U.catalogue_page(*lit("grc")), U.file_stem(*lit("x/a.b.c.xml"))).first() == ("g/a/b/c/card", "g/a/b/c/chunk_3.html", "g/a/b/c/index.json", "catalog/grc.html", "a.b.c")
    words = tokens.split_tokens(spark.createDataFrame([(1, "Sing , sing")], "doc_id long, text string"))
    named = tokens.with_token_urns(tokens.number_occurrences(words, ["doc_id"]), F.lit("u:1"))
    assert {r.pos: r.urn for r in named.collect()} == {1: "u:1@sing[1]", 2: None, 3: "u:1@sing[2]"}


def test_gazetteer_and_options(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"a1": {"name": "Ann", "abbreviations": ["An."], "works": [{"urn": "urn:cts:g:a.b", "title": "One", "abbreviations": ["On."]}, {"urn": "urn:cts:g:a.d", "title": "Two"}]}}))
    records = citation.read_gazetteer(spark, str(tmp_path / "g.json"))
    authors, works = citation.gazetteer_tables(records, spark.createDataFrame([("urn:cts:g:a.b",), ("urn:cts:g:a.d",)], "work_urn string"))
    queries = spark.createDataFrame([(1, "An. On. 2.1"), (2, "An. 3")], "query_id int, text string")
    options = citation.citation_options(citation.match_citations(queries, authors, works), authors, works, queries)
    versions = spark.createDataFrame([("urn:cts:g:a.b", "urn:cts:g:a.b.v", "grc", 0)], "work_urn string, urn string, language string, pos int")
    chunks = spark.createDataFrame([("urn:cts:g:a.b.v", [2], "2", 0), ("urn:cts:g:a.b.v", [3, 1], "3.1", 1), ("urn:cts:g:a.b.v", [3, 2], "3.2", 2)], "urn string, key array<bigint>, passage string, pos int")
    assert sorted((r.query_id, r.href) for r in citation.option_links(options, versions, chunks).collect()) == [(1, "/urn:cts:g:a.b.v:2/"), (2, "/urn:cts:g:a.b.v:3.1/")]


def test_stored_index(spark, tmp_path):
    texts = spark.createDataFrame([(1, "La rose, la Rose; " * 20), (2, "là!"), (3, None)], "doc_id long, text string")
    folder = search_index.write_index(texts, str(tmp_path / "index"), "fr")
    found = search_index.open_index(spark, folder)
    assert {r.form: r.n for r in search_index.find_keys(found.forms, "la", loose=True).collect()} == {"la": 40, "là": 1}
    assert [r.pos for r in search_index.hits_of(found, "rose").orderBy("pos").limit(2).collect()] == [2, 4]
    assert {r.doc_id: r.n_words for r in found.documents.collect()} == {1: 80, 2: 1} and found.lemmas.count() > 0
    assert {(r.lemma, r.form, r.upos, r.feats) for r in found.analyses.join(found.features, "feat_id").collect() if r.form == "rose"} == {("rose", "rose", "X", "Form=whole")}
    assert found.parts.where("doc_id = 1").count() == 3 and search_index.open_index(spark, folder) is found
    with pytest.raises(FileNotFoundError, match="404"):
        search_index.open_index(spark, str(tmp_path / "nothing"))


def test_contents(spark):
    sidecar = '{"toc":[{"urn":"u:1","label":"One"},{"urn":"u:1.1","label":"In","parent":0}]}'
    got = toc.contents_of(spark.createDataFrame([("v", sidecar), ("w", "{}")], "version string, json string"), "card")
    assert {(r.doc, r.urn): r.target for r in got.collect()} == {("v", "u:1"): None, ("v", "u:1.1"): "card"}


def test_windows_of_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:05:00", "a"), ("2024-01-01 00:25:00", "b"), ("2024-01-01 02:00:00", "b")], "at string, kind string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    counted = arrivals.counts_in_windows(arrivals.arriving(spark, str(tmp_path / "in"), rows.schema), "at", "kind")
    query = counted.select("kind", "n").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())[:2] == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_alignment_against_all_pairs(spark, seed):
    r = random.Random(seed)
    key = lambda: [r.randint(1, 6) for _ in range(r.randint(1, 3))]
    starts = [key() for _ in range(25)]
    chunks = chunk_frame(spark, starts)
    probes = [key() for _ in range(12)]
    frame = spark.createDataFrame([(1, k, p) for k, p in enumerate(probes)], "v int, k int, key array<bigint>")
    near = {x.k: x.nearest for x in align.nearest_join(frame, chunks, ["v"], "key", "start", F.col("chunk"), "pos").collect()}
    land = {x.k: x.landing for x in align.prefix_floor_join(frame, chunks, ["v"], "key", "start", F.col("chunk"), "pos").collect()}
    spans = [(k, min(a, b), max(a, b)) for k, (a, b) in enumerate(zip(probes, probes[1:] + probes[-1:], strict=True))]
    held = align.range_join(spark.createDataFrame([(1, *s) for s in spans], "v int, k int, low array<bigint>, high array<bigint>"), chunks, ["v"], "low", "high", "start").collect()
    for k, p in enumerate(probes):
        gap = lambda s: [abs((s[i : i + 1] or [0])[0] - (p[i : i + 1] or [0])[0]) for i in range(max(len(s), len(p)))]  # noqa: B023, E731
        assert near[k] == str(min(starts, key=gap))
        below = [s for s in starts if s[: len(p)] == p]
        before = [s for s in starts if s <= p]
        assert land[k] == str(min(below) if below else max(before) if before else starts[0])
    want = sorted((k, i) for k, low, high in spans for i, s in enumerate(starts) if low <= s <= high or (low == high and len(s) > len(low) and s[: len(low)] == low))
    assert sorted((x.k, x.pos) for x in held) == want


def test_places(spark):
    rows = [(k, (k * 37) % 11) for k in range(200)]
    got = ranking.global_places(spark.createDataFrame(rows, "k int, n int"), [F.desc("n"), F.asc("k")], "place").collect()
    assert [(x.k, x.n) for x in sorted(got, key=lambda x: x.place)] == sorted(rows, key=lambda x: (-x[1], x[0])) and sorted(x.place for x in got) == list(range(1, 201))
