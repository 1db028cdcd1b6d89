"""Queries on the graph of artefacts and methods: closures, levels, ports. link(method, role, port, artefact)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.roots import filesystem
from ..sources.tables import settle, stored

#: nodes that may be sent to all tasks
FEW = 100_000


def producers(link: DataFrame) -> DataFrame:
    return link.filter("role = 'out'").select("artefact", F.col("method").alias("producer"), F.col("port").alias("out_port"))


def consumers(link: DataFrame) -> DataFrame:
    return link.filter("role = 'in'").select("artefact", F.col("method").alias("consumer"), F.col("port").alias("in_port"))


def artefact_edges(link: DataFrame) -> DataFrame:
    """(src, dst): each input of a method to each of its outputs."""
    ins = link.filter("role = 'in'").select("method", F.col("artefact").alias("src"))
    outs = link.filter("role = 'out'").select("method", F.col("artefact").alias("dst"))
    return ins.join(outs, "method").select("src", "dst").distinct()


def closure(edges: DataFrame | list[tuple[str, DataFrame]], roots: DataFrame) -> DataFrame:
    """node, depth of all that the roots (node) depend on, themselves included: a frontier moves against the edges.

    Edges are written once. Edges of tables may be given in parts instead, each with what all its dst begin with: a round reads the parts
    that it may meet where they lie, and those that none meets are neither written nor read. Each round joins only what the last one found and writes only what is new; nodes met before
    are left out, so diamonds cost nothing twice. Of edges, and of nodes met before, a round takes only those between its least and its
    greatest node: where names begin with a kind, other kinds are neither read nor shuffled.
    """
    place = None
    if isinstance(edges, DataFrame):
        whole, place = stored(edges.select("src", "dst"), "edges")
        edges = [("", whole)]
    found, _ = stored(roots.select("node"), "roots")
    reached, met, depth = None, [], 0
    while True:
        part = found.withColumn("depth", F.lit(depth))
        reached = part if reached is None else reached.union(part)
        n, low, high = found.agg(F.count("node"), F.min("node"), F.max("node")).first()
        if not n:
            break
        met.append((low, high, found))
        depth += 1
        some = [e.select("src", "dst").filter(F.col("dst").between(F.lit(low), F.lit(high))) for beginning, e in edges if low[: len(beginning)] <= beginning <= high]
        if not some:
            break
        some = functools.reduce(DataFrame.union, some)
        back, _ = stored(some.join(_small(found, n), F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct(), "found")
        n, low, high = back.agg(F.count("node"), F.min("node"), F.max("node")).first()
        known = [f.filter(F.col("node").between(F.lit(low), F.lit(high))) for a, b, f in met if n and a <= high and low <= b]
        if known:
            known = functools.reduce(DataFrame.union, known)
            if n <= FEW:
                known = known.join(F.broadcast(back), "node", "left_semi")
            back, _ = stored(back.join(known, "node", "left_anti"), "found")
        found = back
    if place is not None:
        system, path = filesystem(place)
        system.delete_dir(path)
    return reached


def _small(rows: DataFrame, n: int) -> DataFrame:
    """The rows, sent to all tasks if they are few, so that what they are joined to isn't shuffled."""
    return F.broadcast(rows) if n <= FEW else rows


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: length of the longest path that ends at it; a cycle is an error.

    What comes from nowhere is at level 0, and edges from there come from one place. A node with one place before it hangs on that:
    such paths and trees are contracted by pointer doubling, so that a chain takes rounds in the logarithm of its
    length. What is left, nodes with several places before them, is treated again with the lengths of the contracted paths on
    its edges; parallel edges count as the longest of them. Each time at least one level of such nodes goes.
    """
    edges = settle(edges.select("src", "dst").distinct())
    nodes = settle(nodes.select("node").distinct())
    first = settle(nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
    done = first.select("node", F.lit(0).alias("level"))
    # src is null for the place that all paths begin at
    rest = edges.join(first.select(F.col("node").alias("src"), F.lit(True).alias("begins")), "src", "left").select(F.when(F.col("begins").isNull(), F.col("src")).alias("src"), "dst", F.lit(1).alias("length"))
    hanging = None  # node, up, length: nodes that were contracted into one which is still there
    while True:
        rest = settle(rest.groupBy("src", "dst").agg(F.max("length").alias("length")))
        if rest.isEmpty():
            break
        single = rest.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("up"), F.first("length").alias("length")).filter("n = 1")
        pointers = _doubled(single.select(F.col("dst").alias("node"), "up", "length"))
        if pointers.isEmpty():
            raise ValueError("the graph has a cycle")
        moved = pointers.select(F.col("node").alias("at"), F.col("up").alias("to"), F.col("length").alias("more"), F.lit(True).alias("known"))
        up, length = F.when(F.col("known"), F.col("to")), F.coalesce("more", F.lit(0))
        if hanging is not None:
            joined = hanging.join(moved, F.col("up") == F.col("at"), "left")
            hanging = joined.select("node", F.coalesce(up, F.when(F.col("known").isNull(), F.col("up"))).alias("up"), (F.col("length") + length).alias("length"))
        hanging = settle(pointers if hanging is None else hanging.union(pointers))
        done = done.union(hanging.filter("up is null").select("node", F.col("length").alias("level")))
        hanging = hanging.filter("up is not null")
        several = rest.join(pointers.select(F.col("node").alias("dst")), "dst", "left_anti")
        joined = several.filter("src is not null").join(moved, F.col("src") == F.col("at"), "left")
        joined = joined.select(F.when(F.col("known"), F.col("to")).otherwise(F.col("src")).alias("src"), "dst", (F.col("length") + length).alias("length"))
        rest = joined.union(several.filter("src is null").select("src", "dst", "length"))
    return done


def _doubled(pointers: DataFrame) -> DataFrame:
    """node, up, length: where each node's pointers lead in the end, and how far; null is the place that all begin at. Each round
    doubles the way that a pointer goes. Pointers that have come to their end aren't joined any more, nor are the few nodes that very
    many pointers lead to shuffled by, so that no task gets all of either."""
    pointers = settle(pointers)
    rounds = max(1, pointers.count()).bit_length() + 1
    ended, moving = pointers.filter("up is null"), pointers.filter("up is not null")
    for _ in range(rounds):
        ups = moving.select(F.col("up").alias("at")).distinct()
        n = ups.count()
        if not n:
            return ended
        next_ = ended.union(moving).select(F.col("node").alias("at"), F.col("up").alias("to"), F.col("length").alias("more"))
        if n <= FEW:
            next_ = F.broadcast(next_.join(F.broadcast(ups), "at", "left_semi"))
        joined = moving.join(next_, F.col("up") == F.col("at"), "left")
        met = F.col("at").isNotNull()
        moved = settle(joined.select("node", F.when(met, F.col("to")).otherwise(F.col("up")).alias("up"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), met.alias("met")))
        ended = ended.union(moved.filter("not met or up is null").drop("met"))
        moving = moved.filter("met and up is not null").drop("met")
    raise ValueError("the graph has a cycle")


def traced(rows: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """The rows with what they come from, one step after the other: (the ancestors, the column that names one, the ancestors' own key). Each
    step is a join by key; a row without an ancestor goes, and the key isn't kept twice."""
    for ancestors, column, key in steps:
        rows = rows.join(ancestors, F.col(column) == F.col(key)).drop(key)
    return rows


def counts(link: DataFrame) -> DataFrame:
    """artefacts, methods: how many the graph has; an artefact that no method makes counts as made by a source method."""
    made = link.filter("role = 'out'").select("method").union(sources(link).select("artefact"))
    return link.select(F.count_distinct("artefact").alias("artefacts")).crossJoin(made.select(F.count_distinct("method").alias("methods")))


def method_ids(outputs: DataFrame) -> DataFrame:
    """Id of each method: its smallest output."""
    return outputs.groupBy("method").agg(F.min("artefact").alias("method_id"))


def ports(link: DataFrame) -> DataFrame:
    """Producer's port (the first that has the artefact) to each consuming port."""
    first = producers(link).groupBy("artefact", "producer").agg(F.min("out_port").alias("out_port"))
    return first.join(consumers(link), "artefact").select("artefact", "producer", "out_port", "consumer", "in_port")


def add_methods(link: DataFrame, new: DataFrame) -> DataFrame:
    """The links with methods replaced by their new definitions."""
    return link.join(new.select("method").distinct(), "method", "left_anti").unionByName(new)


def add_absent(link: DataFrame, new: DataFrame) -> DataFrame:
    """The links with those of new methods whose ids aren't there yet; a method that is there stays as it is, also if its new definition
    differs. A method's id is its smallest output."""
    ids = lambda rows: method_ids(rows.filter("role = 'out'"))
    there = ids(link).select("method_id").distinct()
    absent = ids(new).join(there, "method_id", "left_anti").select("method")
    return link.unionByName(new.join(absent, "method", "left_semi"))


def looked_up(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The known rows of the wanted keys, each once; a key that isn't known is an error."""
    both = wanted.select(key).distinct().join(known.dropDuplicates([key]).withColumn("known_", F.lit(True)), key, "left")
    checked = F.when(F.col("known_"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("nothing is known of "), F.col(key).cast("string"))).cast(known.schema[key].dataType))
    return both.withColumn(key, checked).drop("known_")


def sources(link: DataFrame) -> DataFrame:
    """Artefacts that no method produces."""
    return link.select("artefact").distinct().join(producers(link).select("artefact").distinct(), "artefact", "left_anti")
