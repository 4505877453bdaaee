"""The XML source: which files are read, tree numbers against whole trees, broken and very large documents."""

import random
import tracemalloc
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from loculus.operators import overlap, toc
from loculus.sources import xml_source

TEI = b"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body><div n="urn:cts:g:a.b.c" type="edition">
<div type="book" n="1"><div type="section" n="1">one <w xml:id="w1">two</w> tail</div><div type="section" n="2" corresp="urn:cts:g:x.y:3">three</div></div>
<div type="strophe" n="1"><l n="7">seven</l></div></div></body></text></TEI>"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("corp")
    for path, content in {
        "r1/data/a/a.b.c.xml": TEI,
        "r1/data/a/__cts__.xml": b"<x/>",
        "r1/outside.xml": TEI,
        "r2/broken.xml": b"<TEI><body><div n='urn:cts:g:late'>",
        "r2/empty.xml": b"",
        "r2/deep/other.xml": b'<TEI><text><body xml:base="urn:cts:g:o.p.q"><div n="urn:cts:no"/></body></text></TEI>',
        "r3/unbound.xml": b"<tei:TEI/>",
    }.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(content)
    return str(at)


def test_documents(spark, root):
    rows = xml_source.read_elements(spark, root, rows="documents").collect()
    assert sorted((r.repo, r.rel_path, r.version, r.urn) for r in rows) == [
        ("r1", "data/a/a.b.c.xml", "a.b.c", "urn:cts:g:a.b.c"),
        ("r2", "broken.xml", "broken", "urn:cts:g:late"),
        ("r2", "deep/other.xml", "other", "urn:cts:g:o.p.q"),
        ("r2", "empty.xml", "empty", None),
        ("r3", "unbound.xml", "unbound", None),
    ]


def test_elements_and_leaves(spark, root):
    nodes = xml_source.read_elements(spark, root)
    states = {r.rel_path: (r.status, r.n) for r in nodes.groupBy("rel_path", "status").agg(F.count("*").alias("n")).collect()}
    assert states["data/a/a.b.c.xml"] == ("ok", 11) and all(states[f] == ("failed", 1) for f in ("broken.xml", "empty.xml", "unbound.xml"))
    leaves = overlap.citable_leaves(nodes.where("status = 'ok'").withColumn("doc", F.col("rel_path")))
    assert sorted((r.n, r.text) for r in leaves.where("repo = 'r1'").collect()) == [("1", "one  tail"), ("2", "three"), ("7", "seven")]
    word = nodes.where("tag = 'w'").first()
    assert (word.ids, word.text, word.parent, word.path) == (["w1"], "two", 6, [0, 1, 0, 0, 0, 0, 0])


def test_filters_choose_files(spark, root):
    reader = xml_source.CitedXmlReader({"path": root}, None)
    files = lambda: [f[2] for p in reader.partitions() for f in p.files]
    assert len(files()) == 5
    kept = list(reader.pushFilters([EqualTo(("repo",), "r2"), GreaterThan(("depth",), 1), StringStartsWith(("rel_path",), "deep/"), In(("version",), ("other", "x"))]))
    assert [type(f) for f in kept] == [GreaterThan] and files() == ["deep/other.xml"]
    found = xml_source.read_elements(spark, root).where("repo = 'r2' and version in ('other', 'none') and depth > 0")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "depth" in plan and " = r2" not in plan  # Spark has only the rest of the filter to do
    assert {r.tag for r in found.collect()} == {"text", "body", "div"}
    assert xml_source.read_elements(spark, root).where("repo = 'nowhere'").count() == 0


def random_xml(r, depth=0):
    inner = "".join(random_xml(r, depth + 1) for _ in range(r.randrange(4))) if depth < 5 else ""
    number = f' n="{r.randrange(9)}"' if r.random() < 0.6 else ""
    kind = ' type="strophe"' if r.random() < 0.1 else ""
    return f"<div{number}{kind}>a{inner}b</div>"


@pytest.mark.parametrize("seed", range(20))
def test_numbers_against_whole_trees(seed):
    content = random_xml(random.Random(seed)).encode()
    size = random.Random(seed).choice([1, 7, 1000])
    rows = sorted(xml_source.elements(lambda: (content[k : k + size] for k in range(0, len(content), size))), key=lambda x: x["enter"])
    every = list(ET.fromstring(content).iter())
    assert [x["enter"] for x in rows] == list(range(len(every)))
    for x, el in zip(rows, every, strict=True):
        assert x["leave"] - x["enter"] + 1 == sum(1 for _ in el.iter()) and x["n"] == el.get("n")
        assert x["text"] == (el.text or "") + "".join(c.tail or "" for c in el)
        if x["parent"] is not None:
            assert el in list(every[x["parent"]])


def test_leaves_against_whole_trees(spark):
    docs = {f"d{k}": random_xml(random.Random(k)).encode() for k in range(15)}
    rows = [(d, x["enter"], x["leave"], x["tag"], x["type"], x["n"]) for d, c in docs.items() for x in xml_source.elements(lambda c=c: iter([c]))]
    nodes = spark.createDataFrame(rows, "doc string, enter long, leave long, tag string, type string, n string").repartition(4)

    def cites(el):
        return el.get("n") and el.get("type") != "strophe"

    want = []
    for d, content in docs.items():
        for k, el in enumerate(ET.fromstring(content).iter()):
            if cites(el) and not any(cites(e) for e in list(el.iter())[1:]):
                want.append((d, k))
    assert sorted((r.doc, r.enter) for r in overlap.citable_leaves(nodes).collect()) == sorted(want)


def test_a_large_document_in_little_memory():
    """200 MB in a million elements: what is held at a time doesn't grow with it."""
    line = b'<l n="1">' + b"x" * 191 + b"</l>"
    pieces = lambda: (p for k in range(206) for p in ([b"<TEI>"] if k == 0 else [b"</TEI>"] if k == 205 else [line * 4975]))
    tracemalloc.start()
    try:
        count = sum(1 for _ in xml_source.elements(pieces))
        assert count == 204 * 4975 + 1 and tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_contents_are_numbered(spark):
    rows = [("d", k, p, k, f"u:{k}") for k, p in [(1, None), (2, 1), (3, 1), (4, 3), (5, None), (6, 99), (7, 8), (8, 7)]]
    nodes = spark.createDataFrame(rows, "doc string, node int, parent int, pos int, urn string")
    got = {r.node: (r.enter, r.leave) for r in toc.tree_numbers(nodes).collect()}
    assert got == {1: (0, 3), 2: (1, 1), 3: (2, 3), 4: (3, 3), 5: (4, 4), 6: (5, 5), 7: (None, None), 8: (None, None)}
    path = toc.opened_path(toc.tree_numbers(nodes), "u:4").collect()
    assert sorted((r.steps, r.node) for r in path) == [(0, 4), (1, 3), (2, 1)]
