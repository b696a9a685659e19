"""Graph files: what is written is read again, by us and by other libraries."""

import json
from xml.etree import ElementTree

import pytest

from skeinwork.sources import graph_files

NODES = [("a", 5, 1.5, True, ["y", "x"], None), ("b <&> \"q\"'", None, None, False, [], "tab\tand\x01\n漢"), ("c", 7, -2e-7, None, None, "")]
EDGES = [("a", "b <&> \"q\"'", 3.5, "k&"), ("c", "a", 2.0, None)] + [("c", f"n{i}", float(i), "m") for i in range(50)]


def frames(spark):
    return spark.createDataFrame(NODES, "node string, n long, x double, flag boolean, names array<string>, said string").repartition(2), spark.createDataFrame(EDGES, "src string, dst string, weight double, mechanism string").repartition(3)


@pytest.mark.parametrize("form", ["graphml", "json"])
def test_round_trip(spark, tmp_path, form):
    nodes, edges = frames(spark)
    path = str(tmp_path / form)
    for _ in range(2):  # the second replaces the first
        graph_files.write_graph_files(nodes, edges, path, form)
    got, links = graph_files.read_graph_files(spark, path, form, {"n": "long", "x": "double", "flag": "boolean", "names": "string", "said": "string"}, {"weight": "double", "mechanism": "string"})
    said = (lambda s: None if s is None else s.replace("\x01", "�")) if form == "graphml" else (lambda s: s)
    assert {tuple(r) for r in got.collect()} == {(a, n, x, f, None if names is None else "|".join(sorted(names)), said(s)) for a, n, x, f, names, s in NODES}
    assert {tuple(r) for r in links.collect()} == set(EDGES)
    assert got.count() == len(NODES) and links.count() == len(EDGES)


def test_other_libraries_read_one_document(spark, tmp_path):
    nodes, edges = frames(spark)
    graph_files.write_graph_files(nodes, edges, str(tmp_path / "x"), "graphml", directed=False, documents=1)
    graph_files.write_graph_files(nodes, edges, str(tmp_path / "j"), "json", documents=1)
    (file,) = (tmp_path / "x").glob("part-*.graphml")
    root = ElementTree.parse(file).getroot()
    of = lambda tag: root.findall(f".//{{{graph_files.SPACE}}}{tag}")
    assert {n.get("id") for n in of("node")} == {n[0] for n in NODES} and len(of("edge")) == len(EDGES) and of("graph")[0].get("edgedefault") == "undirected"
    assert {(k.get("for"), k.get("attr.name"), k.get("attr.type")) for k in of("key")} >= {("node", "n", "long"), ("node", "flag", "boolean"), ("edge", "weight", "double")}
    (file,) = (tmp_path / "j").glob("part-*.json")
    doc = json.loads(file.read_text())
    assert {(e["source"], e["target"]): e["weight"] for e in doc["links"]} == {(s, t): w for s, t, w, _ in EDGES} and {n["id"]: n.get("n") for n in doc["nodes"]} == {n[0]: n[1] for n in NODES}


def test_documents_of_other_tools(spark, tmp_path):
    (tmp_path / "other.graphml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="edge" attr.name="weight" attr.type="int"/><graph edgedefault="undirected"><node id="1"/><node id="2"><data key="d9">z</data></node><edge source="1" target="2"><data key="d0">4</data></edge></graph></graphml>')
    nodes, edges = graph_files.read_graph_files(spark, str(tmp_path / "other.graphml"), node_types={"d9": "string"})
    assert {tuple(r) for r in nodes.collect()} == {("1", None), ("2", "z")} and [tuple(r) for r in edges.collect()] == [("1", "2", 4.0)]
    (tmp_path / "other.json").write_text(json.dumps({"nodes": [{"id": 1}, {"id": 2, "tags": ["a"]}], "edges": [{"source": 1, "target": 2, "weight": 3, "key": 0}]}))
    nodes, edges = graph_files.read_graph_files(spark, str(tmp_path / "other.json"), "json", {"tags": "string"})
    assert {tuple(r) for r in nodes.collect()} == {("1", None), ("2", '["a"]')} and [tuple(r) for r in edges.collect()] == [("1", "2", 3.0)]
