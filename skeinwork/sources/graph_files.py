"""Graphs as GraphML and as node-link JSON, by the Python Data Source API: each task writes its rows as a whole document of its own, and
each document is read by a task of its own, so no graph passes through the driver. One partition makes one document.

A row is a node (kind 'node', id) or an edge (kind 'edge', src, dst) with its attributes as text. Options: format ('graphml' or 'json') and,
for writing, keys (JSON: names and types of the attributes of nodes and of edges) and directed ('true' or 'false'). Documents from other
tools are read too; attributes without a declared type are strings. Characters that XML cannot hold become U+FFFD in GraphML."""

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "kind string, id string, src string, dst string, attributes map<string, string>"
SPACE = "http://graphml.graphdrawing.org/xmlns"
#: Types of attributes: Spark's and GraphML's.
TYPES = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean", "string": "string"}
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")
ENDINGS = {"graphml": ".graphml", "json": ".json"}


def file_system(path: str):
    """pyarrow's file system for a path or URI that driver and executors share, and the path there."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class GraphFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, overwrite)


class Document(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options):
        self.at, self.format = options["path"], options.get("format", "graphml")

    def partitions(self) -> list[Document]:
        from pyarrow import fs

        system, path = file_system(self.at)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Document(path)]
        return [Document(x.path) for x in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path) if x.path.endswith(ENDINGS[self.format])]

    def read(self, partition: Document) -> Iterator[tuple]:
        system, _ = file_system(self.at)
        with system.open_input_stream(partition.path) as stream:
            yield from (graphml_rows if self.format == "graphml" else json_rows)(stream)


def graphml_rows(stream) -> Iterator[tuple]:
    """Rows of a GraphML document, element by element: what is read is let go."""
    from xml.etree import ElementTree

    names, local = {}, lambda tag: tag.rpartition("}")[2]
    steps = ElementTree.iterparse(stream, ("start", "end"))
    for event, e in steps:
        tag = local(e.tag)
        if event == "start":
            if tag == "graph":
                graph = e
            continue
        if tag == "key":
            names[e.get("id")] = e.get("attr.name") or e.get("id")
        elif tag in ("node", "edge"):
            data = {names.get(d.get("key"), d.get("key")): d.text or "" for d in e if local(d.tag) == "data"}
            yield (tag, e.get("id") if tag == "node" else None, e.get("source"), e.get("target"), data)
            graph.clear()


def json_rows(stream) -> Iterator[tuple]:
    doc = json.loads(stream.read())
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    data = lambda row, without: {k: text(v) for k, v in row.items() if k not in without and v is not None}
    for n in doc.get("nodes", ()):
        yield ("node", text(n["id"]), None, None, data(n, ("id",)))
    for e in doc.get("links", doc.get("edges", ())):
        yield ("edge", None, text(e["source"]), text(e["target"]), data(e, ("source", "target", "key")))


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.at, self.format, self.overwrite = options["path"], options.get("format", "graphml"), overwrite
        self.keys, self.directed = json.loads(options.get("keys", '{"node": {}, "edge": {}}')), options.get("directed", "true") == "true"
        if self.format not in ENDINGS:
            raise ValueError(self.format)

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        system, path = file_system(self.at)
        system.create_dir(path, recursive=True)
        # an attempt that is done over leaves a file that commit takes away
        name = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{ENDINGS[self.format]}"
        with system.open_output_stream(name) as out:
            for piece in (self.graphml if self.format == "graphml" else self.json)(iterator):
                out.write(piece.encode())
        return Written(name)

    def graphml(self, rows) -> Iterator[str]:
        from xml.sax.saxutils import escape, quoteattr

        ids = {(kind, k): f"{kind[0]}{i}" for kind in ("node", "edge") for i, k in enumerate(self.keys[kind])}
        fit = lambda x: UNFIT.sub("�", x)
        yield f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="{SPACE}">\n'
        for (kind, k), i in ids.items():
            yield f'<key id="{i}" for="{kind}" attr.name={quoteattr(k)} attr.type="{TYPES[self.keys[kind][k]]}"/>\n'
        yield f'<graph edgedefault="{"directed" if self.directed else "undirected"}">\n'
        for r in rows:
            held = dict(r.attributes or {})
            data = "".join(f'<data key="{ids[r.kind, k]}">{escape(fit(v))}</data>' for k, v in held.items() if v is not None)
            ends = f"id={quoteattr(fit(r.id))}" if r.kind == "node" else f"source={quoteattr(fit(r.src))} target={quoteattr(fit(r.dst))}"
            yield f"<{r.kind} {ends}>{data}</{r.kind}>\n"
        yield "</graph>\n</graphml>\n"

    def json(self, rows) -> Iterator[str]:
        """Nodes first, as the format has them: a task holds its edges until its nodes are written."""
        def value(kind, k, v):
            t = self.keys[kind].get(k, "string")
            return v if t == "string" else v == "true" if t == "boolean" else json.loads(v) if re.fullmatch(r"-?[0-9][0-9.]*(?:[eE][-+]?[0-9]+)?", v) else None

        data = lambda r: {k: value(r.kind, k, v) for k, v in (r.attributes or {}).items() if v is not None}
        yield f'{{"directed": {json.dumps(self.directed)}, "multigraph": false, "graph": {{}}, "nodes": ['
        links, first = [], True
        for r in rows:
            if r.kind == "edge":
                links.append(json.dumps({"source": r.src, "target": r.dst, **data(r)}, ensure_ascii=False))
            else:
                yield ("" if first else ",") + "\n" + json.dumps({"id": r.id, **data(r)}, ensure_ascii=False)
                first = False
        yield '\n], "links": [\n' + ",\n".join(links) + "\n]}\n"

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, path = file_system(self.at)
        kept = {m.path for m in messages if m is not None}
        for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            base = x.path.rpartition("/")[2]
            if x.type == fs.FileType.File and x.path not in kept and base.startswith("part-") and (self.overwrite or base.split("-")[1] in {k.rpartition("/")[2].split("-")[1] for k in kept}):
                system.delete_file(x.path)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.at)
        for m in messages:
            if m is not None and system.get_file_info(m.path).is_file:
                system.delete_file(m.path)


def kinds(df: DataFrame, without: tuple[str, ...]) -> dict[str, str]:
    return {c: t if t in TYPES else "string" for c, t in df.dtypes if c not in without}


def rows_of(df: DataFrame, kind: str, ends: dict[str, str]) -> DataFrame:
    """df as rows of SCHEMA: nulls have no attribute, arrays are sorted and joined by |."""
    def text(c, t):
        if t.startswith("array"):
            return F.array_join(F.array_sort(F.col(c).cast("array<string>")), "|")
        return F.col(c).cast("string")

    own = [(c, t) for c, t in df.dtypes if c not in ends.values()]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), text(c, t).alias("value")) for c, t in own]) if own else F.array().cast("array<struct<key: string, value: string>>")
    data = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    at = lambda name: F.col(ends[name]).cast("string") if name in ends else F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), at("id").alias("id"), at("src").alias("src"), at("dst").alias("dst"), data.alias("attributes"))


def write_graph_files(nodes: DataFrame, edges: DataFrame, path: str, form: str = "graphml", directed: bool = True, documents: int | None = None) -> None:
    """nodes: node and attributes; edges: src, dst and attributes. A document for each partition (or so many), which replace what is at path."""
    spark = nodes.sparkSession
    spark.dataSource.register(GraphFiles)
    both = rows_of(nodes, "node", {"id": "node"}).unionByName(rows_of(edges, "edge", {"src": "src", "dst": "dst"}))
    both = both if documents is None else both.coalesce(1) if documents == 1 else both.repartition(documents)
    keys = {"node": kinds(nodes, ("node",)), "edge": kinds(edges, ("src", "dst"))}
    both.write.format("graph_files").option("format", form).option("keys", json.dumps(keys)).option("directed", str(directed).lower()).mode("overwrite").save(path)


def read_graph_files(spark: SparkSession, path: str, form: str = "graphml", node_types: dict[str, str] | None = None, edge_types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node and attributes) and edges (src, dst and attributes) of the documents at path. types: attributes to take and Spark types; for an
    edge's weight double if nothing is said."""
    spark.dataSource.register(GraphFiles)
    rows = spark.read.format("graph_files").option("format", form).load(path)
    typed = lambda types: [F.try_element_at("attributes", F.lit(k)).try_cast(t).alias(k) for k, t in types.items()]
    nodes = rows.where("kind = 'node'").select(F.col("id").alias("node"), *typed(node_types or {}))
    return nodes, rows.where("kind = 'edge'").select("src", "dst", *typed({"weight": "double"} if edge_types is None else edge_types))
