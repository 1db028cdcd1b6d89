"""Decisions on staleness: expected against actual versions, presence in stores, and their propagation.

The first condition that holds decides (``group_decision``):
some element was never expected -> SomeAreLocalUnexpected; all equal -> AllExist; all that differ are absent and
stored -> AllExist (those Remote); all that differ are absent, some not stored -> SomeAreNotFound;
otherwise some element has another version -> SomeAreLocalUnexpected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, REMOTE, NOT_FOUND, UNEXPECTED = "Local", "Remote", "NotFound", "LocalUnexpected"
ALL_EXIST, SOME_NOT_FOUND, SOME_UNEXPECTED = "AllExist", "SomeAreNotFound", "SomeAreLocalUnexpected"
INPUTS, OUTPUTS, UP_TO_DATE = "InputsOutdated", "OutputsOutdated", "UpToDate"


def expectations(links: DataFrame, actual: DataFrame, index: list[str]) -> DataFrame:
    """Each expected element of the links with its actual version, if any."""
    return links.join(actual, index, "left")


def presence(versions: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """The rows with in_store: whether any store holds their version."""
    held = stored.select(F.col("version").alias(version)).distinct().withColumn("held", F.lit(True))
    return versions.join(held, version, "left").withColumn("in_store", F.coalesce("held", F.lit(False))).drop("held")


def link_status(rows: DataFrame) -> Column:
    """Status of one element from its columns expected, actual, in_store."""
    return (
        F.when(F.col("expected").isNull(), UNEXPECTED)
        .when(F.col("expected").eqNullSafe(F.col("actual")), LOCAL)
        .when(F.col("actual").isNotNull(), UNEXPECTED)
        .when(F.col("in_store"), REMOTE)
        .otherwise(NOT_FOUND)
    )


def group_decision(elements: DataFrame, by: list[str]) -> DataFrame:
    """elements: expected, actual, in_store. One row per group: decision, n, remote (elements to be found in stores only)."""
    status = elements.withColumn("status", link_status(elements))
    n = lambda s: F.count_if(F.col("status") == s)
    grouped = status.groupBy(*by).agg(F.count("*").alias("n"), n(UNEXPECTED).alias("unexpected"), n(NOT_FOUND).alias("missing"), n(REMOTE).alias("remote"))
    decision = F.when(F.col("unexpected") > 0, SOME_UNEXPECTED).when(F.col("missing") > 0, SOME_NOT_FOUND).otherwise(ALL_EXIST)
    return grouped.select(*by, decision.alias("decision"), "n", F.when(decision == ALL_EXIST, F.col("remote")).otherwise(0).cast("long").alias("remote"))


def instance_status(inputs: Column, outputs: Column) -> Column:
    """State of a method instance: inputs are looked at first. Absent groups count as complete."""
    ok = lambda d: F.coalesce(d, F.lit(ALL_EXIST)) == ALL_EXIST
    return F.when(~ok(inputs), INPUTS).when(~ok(outputs), OUTPUTS).otherwise(UP_TO_DATE)


def source_status(status: Column) -> Column:
    """Location of a source's element; one that is nowhere is an error."""
    return F.when(status.isin(LOCAL, UNEXPECTED), LOCAL).when(status == REMOTE, REMOTE).otherwise(F.raise_error(F.lit("a source is neither on disk nor in a store")))


def propagate_status(methods: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """method, status: a method below one that isn't up to date has outdated inputs, whatever its own state.

    methods: method; edges: (producer, consumer); own: method, status by itself. A frontier of methods with newly
    outdated inputs moves down until it is empty: as many rounds as the longest chain, each a join of what is new.
    """
    from ..sources.tables import settle

    outdated = settle(own.filter(F.col("status") != UP_TO_DATE).select("method"))
    reached = frontier = outdated
    while True:
        below = edges.join(frontier.withColumnRenamed("method", "producer"), "producer").select(F.col("consumer").alias("method")).distinct()
        frontier = settle(below.join(reached, "method", "left_anti"))
        if frontier.isEmpty():
            break
        reached = settle(reached.union(frontier))
    blocked = edges.join(reached.withColumnRenamed("method", "producer"), "producer").select(F.col("consumer").alias("method")).distinct().withColumn("blocked", F.lit(True))
    status = F.when(F.col("blocked"), INPUTS).otherwise(F.col("status"))
    return methods.join(own, "method").join(blocked, "method", "left").select("method", status.alias("status"))


def propagate_elements(own: DataFrame, edges: DataFrame) -> DataFrame:
    """method, instance, status of all instances: one that depends on an instance which isn't up to date has outdated inputs.

    own: method, instance (array), status by itself; edges: producer, consumer, shared (how many index parts both have: all of a map's,
    those of the producer in a scatter, those of the consumer in a reduction). An instance depends on those of the producer that begin
    with the same shared parts. A frontier of newly outdated instances moves down, its keys cut to the shared parts and each taken once:
    as many rounds as the longest chain of methods, each a join of what is new, for all methods together.
    """
    from ..sources.tables import settle

    own = settle(own.select("method", "instance", "status"))
    if edges.isEmpty() or own.filter(F.col("status") != UP_TO_DATE).isEmpty():
        return own
    key = lambda n: F.slice("instance", F.lit(1), n)
    slots = settle(own.join(edges.select(F.col("consumer").alias("method"), "shared").distinct(), "method").select("method", "shared", key(F.col("shared")).alias("key"), "instance"))
    frontier = settle(own.filter(F.col("status") != UP_TO_DATE).select("method", "instance"))
    reached, blocked = frontier, None
    while True:
        below = frontier.join(edges.withColumnRenamed("producer", "method"), "method").select(F.col("consumer").alias("method"), "shared", key(F.col("shared")).alias("key")).distinct()
        hit = settle(slots.join(below, ["method", "shared", "key"], "left_semi").select("method", "instance").distinct())
        blocked = hit if blocked is None else settle(blocked.union(hit).distinct())
        frontier = settle(hit.join(reached, ["method", "instance"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = settle(reached.union(frontier))
    marked = own.join(blocked.withColumn("blocked", F.lit(True)), ["method", "instance"], "left")
    return marked.select("method", "instance", F.when(F.col("blocked"), INPUTS).otherwise(F.col("status")).alias("status"))


def record_expectations(old: DataFrame, actual: DataFrame, index: list[str]) -> DataFrame:
    """Expectations after a successful run: the actual versions; those without one are dropped."""
    return old.select(*index, "expected").join(actual.select(*index, "actual"), index, "full_outer").filter("actual is not null").select(*index, F.col("actual").alias("expected"))


def invalidated(expected: DataFrame, signatures_valid: Column) -> DataFrame:
    """Expected versions of outputs are voided where the method's signature doesn't fit its definition."""
    return expected.withColumn("expected", F.when(signatures_valid, F.col("expected")))


def succeeded(exit_code: Column, accepted: Column) -> Column:
    return F.array_contains(accepted, exit_code)


def fresh_hashes(data: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Cached digests by key: hit if strictly newer than the data, stale if not, orphan without data, miss without cache."""
    both = data.join(cache, key, "full_outer")
    state = (
        F.when(F.col("mtime").isNull(), "orphan").when(F.col("cache_mtime").isNull(), "miss").when(F.col("cache_mtime") > F.col("mtime"), "hit").otherwise("stale")
    )
    return both.withColumn("state", state)


def restorable(elements: DataFrame, instance: list[str]) -> DataFrame:
    """Inputs that have to be fetched, with the version to fetch (wanted).

    elements: expected, actual, free (whether the element's index is a free one of a reduction) and instance columns; if
    they are to be looked at, produced (the version that the artefact's producer expects) and from_source. What is there needs no
    fetching. What is absent and was expected is fetched, unless it was removed from a reduced vector of which other
    elements are there. What this method never saw takes the version of its producer: without one, a source is an
    error and a method's output is not there yet.
    """
    siblings = elements.filter("free and actual is not null").select(*instance).distinct().withColumn("siblings", F.lit(True))
    joined = elements.join(siblings, instance, "left").filter("actual is null")
    gone = F.col("free") & F.coalesce("siblings", F.lit(False))
    wanted = F.when(F.col("expected").isNotNull(), F.when(~gone, F.col("expected")))
    if "produced" in elements.columns:
        lost = F.col("expected").isNull() & F.col("produced").isNull() & F.col("from_source")
        wanted = F.when(lost, F.raise_error(F.lit("a source is neither in place nor recorded"))).otherwise(F.when(F.col("expected").isNull(), F.col("produced")).otherwise(wanted))
    return joined.withColumn("wanted", wanted).filter("wanted is not null").drop("siblings")


def status_text(state: Column, location: Column) -> Column:
    """What a user is told of an artefact's state."""
    there = F.when(location == REMOTE, "Up to date (in storage)").otherwise("Up to date")
    return F.when(state == UP_TO_DATE, there).otherwise("Need recomputation")
