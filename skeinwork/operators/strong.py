"""Strong components of directed networks without a limit on how long paths are where they don't branch.

Nodes with a single way on (or, seen backwards, a single way in) are followed to its end by pointer doubling, all at once: in as many
rounds as the logarithm of the longest such path. Those that end in a node without a way on are components of their own, those that go
round are a cycle, and the others are drawn into the node where they end, with a note for later. This goes on while it takes
edges away, then colours tell the components of what is left, which branches everywhere. At last the notes are read
backwards: a drawn-in node belongs to the component of its end if that component leads into it, or into a node that leads to it."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]
#: Drawing in goes on while it takes at least this share of the edges away.
WORTH = 0.05


def turned(edges: DataFrame, flip: bool) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if flip else edges


def followed(ways: DataFrame, keep: Keep) -> list[DataFrame]:
    """ways: node, to: the only way on of some nodes. A list of tables node, to, low, open: where each is after 1, 2, 4, ... steps or at
    its end if that comes first, the smallest node on the way there (without the last), and whether there is a way on from there.
    In the last table a node is open only if it goes round, and then it is at a node of the cycle."""
    first = ways.select("node", "to", F.col("node").alias("low"))
    there = ways.select(F.col("node").alias("to"), F.lit(True).alias("on"))
    out = [keep(first.join(there, "to", "left").select("node", "to", "low", F.coalesce("on", F.lit(False)).alias("open")), "ways")]
    rounds = out[0].count().bit_length()
    while rounds > 0 and not out[-1].where("open").isEmpty():
        now = out[-1]
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("low").alias("lower"), F.col("open").alias("further"))
        step = now.join(ahead, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.least("low", F.coalesce("lower", "low")).alias("low"), F.coalesce("further", F.lit(False)).alias("open"))
        out.append(keep(step, "ways"))
        rounds -= 1
    return out


def drawn_in(edges: DataFrame, flip: bool, keep: Keep) -> tuple[DataFrame, DataFrame | None, tuple | None]:
    """edges: distinct src, dst without loops. What is left of them when nodes with a single way on (in, if flip) are drawn into where it
    ends; node, label of the cycles found; and what told needs to place the drawn-in nodes."""
    own = turned(edges, flip)
    out = keep(own.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to")), "out")
    ways = out.where("n = 1").select("node", "to")
    if ways.isEmpty():
        return edges, None, None
    steps = followed(ways, keep)
    last, hubs = steps[-1], out.where("n > 1").select("node")
    round_ = last.where("open")
    cycles = round_.join(round_.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("label"))
    # those that end where nothing goes on, or lead into a cycle, are components of their own: they need no label
    chains = keep(last.where("not open").join(hubs.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to"), "chains")
    from_hubs = own.join(hubs.select(F.col("node").alias("src")), "src", "left_semi")
    entries = from_hubs.join(chains.select(F.col("node").alias("dst"), F.col("to").alias("end")), "dst").select("src", "dst", "end")
    inner = from_hubs.join(hubs.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    rest = inner.unionByName(entries.select("src", F.col("end").alias("dst"))).where("src <> dst").distinct()
    return turned(keep(rest, "rest"), flip), keep(cycles, "cycles"), (steps, chains, keep(entries, "entries"))


def told(labels: DataFrame, note: tuple, keep: Keep) -> DataFrame:
    """labels: node, label of the nodes that were left, where it isn't themselves alone. The same with the drawn-in nodes that belong to the
    component of their end."""
    steps, chains, entries = note
    of = lambda name, out: labels.select(F.col("node").alias(name), F.col("label").alias(out))
    ends = keep(chains.join(of("to", "l"), "to", "left").select("node", F.coalesce("l", "to").alias("label")), "ends")
    known = entries.join(of("src", "l"), "src", "left").join(of("end", "m"), "end", "left")
    marked = keep(known.where(F.coalesce("l", "src") == F.coalesce("m", "end")).select(F.col("dst").alias("node")).distinct(), "marked")
    for step in steps:
        if marked.isEmpty():
            return labels
        on = step.join(marked, "node", "left_semi").select(F.col("to").alias("node")).join(ends.select("node"), "node", "left_semi")
        marked = keep(marked.unionByName(on).distinct(), "marked")
    # an end is labelled as what is drawn into it, even where it was alone before
    inside = ends.join(marked, "node", "left_semi")
    return keep(labels.unionByName(inside), "labels")


def coloured(edges: DataFrame, keep: Keep, most: int) -> DataFrame:
    """node, label of one component for each colour: every node takes the smallest node that reaches it as colour, and what
    reaches a colour's own node within the colour is a component."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour, moved = keep(nodes.select("node", F.col("node").alias("c"), F.lit(True).alias("moved")), "colour"), True
    steps = 0
    while moved:
        steps += 1
        if steps > most:
            raise RuntimeError(f"paths of more than {most} branching nodes: strong components not told apart")
        # only what changed is sent on
        news = edges.join(colour.where("moved").select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
        better = F.coalesce(F.col("m") < F.col("c"), F.lit(False))
        colour = keep(colour.join(news, "node", "left").select("node", F.when(better, F.col("m")).otherwise(F.col("c")).alias("c"), better.alias("moved")), "colour")
        moved = not colour.where("moved").isEmpty()
    of = lambda name, c: colour.select(F.col("node").alias(name), F.col("c").alias(c))
    inner = keep(edges.join(of("src", "c"), "src").join(of("dst", "d"), "dst").where("c = d").select("src", "dst"), "inner")
    fresh = keep(colour.where("node = c").select("node", F.col("c").alias("label")), "reached")
    parts = [fresh]
    for steps in range(most + 1):
        back = inner.join(fresh.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label").distinct()
        for part in parts:
            back = back.join(part.select("node"), "node", "left_anti")
        fresh = keep(back, "reached")
        if fresh.isEmpty():
            break
        if steps == most:
            raise RuntimeError(f"paths of more than {most} branching nodes: strong components not told apart")
        parts.append(fresh)
        if len(parts) > 8:
            parts = [keep(reduce(DataFrame.unionByName, parts), "reached")]
    return keep(reduce(DataFrame.unionByName, parts), "reached")


def strong_components(edges: DataFrame, keep: Keep, most: int = 1000) -> DataFrame:
    """node, root (the smallest node of its strong component) for all nodes of src, dst. most: steps along paths on which every node
    branches both ways; longer ones raise an error, so no root is ever wrong."""
    left, labels, notes = keep(edges.select("src", "dst").where("src <> dst").distinct(), "strong"), [], []
    n = left.count()
    while n:
        before, worth = n, True
        while worth and n:
            size = n
            for flip in (False, True):
                left, cycles, note = drawn_in(left, flip, keep)
                if note is not None:
                    labels.append((len(notes), cycles))
                    notes.append(note)
            n = left.count()
            worth = size - n > WORTH * size
        if not n:
            break
        found = coloured(left, keep, most)
        labels.append((len(notes), found))
        rest = left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = keep(rest, "strong")
        n = left.count()
        if n >= before:
            raise RuntimeError("no component was found in a round")
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    all_labels = every.limit(0).select("node", F.col("node").alias("label"))
    for k in range(len(notes), -1, -1):
        own = [x for at, x in labels if at == k]
        all_labels = reduce(DataFrame.unionByName, own, all_labels)
        if k:
            all_labels = told(all_labels, notes[k - 1], keep)
    named = every.join(all_labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    roots = named.groupBy("label").agg(F.min("node").alias("root"))
    return named.join(roots, "label").select("node", "root")
