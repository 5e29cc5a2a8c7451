"""Neighbourhoods under a budget, degrees, and the shape of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions.temporal import known, valid_at

# Relationship types that are derived, and so left out unless asked for.
DERIVED = ("shares_address_with", "shares_person_with", "same_as")


@dataclass(frozen=True)
class Budget:
    """What a traversal may return."""

    max_depth: int = 2
    max_nodes: int = 300
    fanout: int = 25
    hub_degree: int = 150

    def depth(self, wanted: int | None) -> int:
        return max(1, min(min(2, self.max_depth) if wanted is None else wanted, self.max_depth))


# Depth, nodes and fan-out of the plans.
PLANS = {"free": Budget(1, 75, 15), "pro": Budget(3, 1000, 50), "b2b": Budget(4, 5000, 200)}


def both_ways(relationships: DataFrame) -> DataFrame:
    """Each edge from both its ends, with its direction."""
    rest = [F.col(c) for c in relationships.columns if c not in ("source_id", "target_id")]
    out = relationships.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), F.lit("out").alias("direction"), *rest)
    back = relationships.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), F.lit("in").alias("direction"), *rest)
    return out.unionByName(back)


def oriented() -> list[Column]:
    """source_id and target_id of a directed half-edge, as recorded."""
    out = F.col("direction") == "out"
    return [F.when(out, F.col("from_id")).otherwise(F.col("to_id")).alias("source_id"), F.when(out, F.col("to_id")).otherwise(F.col("from_id")).alias("target_id")]


def degrees(relationships: DataFrame) -> DataFrame:
    """id, degree: live edges at each end. Partial counts keep hubs from shuffling whole."""
    ends = relationships.filter(known()).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def refreshed_degrees(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Every entity with its degree, orphans with 0."""
    return entities.join(degrees(relationships), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def expand(edges: DataFrame, entities: DataFrame, frontier: DataFrame, fanout: int, as_of: str | None, types: list[str] | None = None, derived: bool = False) -> DataFrame:
    """One level: for each frontier id (column from_id) its best fanout half-edges, with the live node they reach.

    frontier may be of any size; a short one is best marked for broadcast by the
    caller. as_of None takes history too. Ranks and matched_degree count edges before
    merged targets are dropped. The degree is a separate aggregate, so that the
    rank filter can prune inside the window.
    """
    near = edges.filter(known()).join(frontier, "from_id", "left_semi")
    if as_of is not None:
        near = near.filter(valid_at(as_of))
    near = near.filter(F.col("relationship_type").isin(types)) if types is not None else near if derived else near.filter(~F.col("relationship_type").isin(*DERIVED))
    order = [F.col("confidence_score").desc(), F.col("valid_to").isNull().desc(), F.col("valid_from").desc_nulls_last(), F.col("id")]
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("from_id").orderBy(*order))).filter(F.col("rn") <= fanout)
    matched = near.groupBy("from_id").agg(F.count("*").alias("matched_degree"))
    alive = entities.filter("merged_into_id is null").select(F.col("id").alias("to_id"), "entity_type", "display_name", F.col("degree").alias("target_degree"))
    return ranked.join(matched, "from_id").join(alive, "to_id")


@dataclass
class Neighborhood:
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


def neighborhood(edges: DataFrame, entities: DataFrame, root: str, budget: Budget = Budget(), depth: int | None = None, as_of: str | None = None, types: list[str] | None = None, derived: bool = False, collapse: bool = True, strict: bool = False) -> Neighborhood:
    """Nodes and edges around root, level by level, within the budget.

    The driver holds accepted ids only, at most budget.max_nodes; edges stay
    distributed. A level accepts new ids in the order of (from_id, rank); hubs
    that could be expanded further are not, are counted, and are marked in
    truncated_expansion. is_current says whether an edge holds at as_of, or today
    where that is None. strict also calls a result truncated if the budget is
    filled exactly and levels are skipped.
    """
    spark = edges.sparkSession
    first = entities.filter(F.col("id") == root).select("entity_type", "display_name", "degree").first()
    if first is None:
        raise KeyError(root)
    nodes = [(root, first["entity_type"], first["display_name"], first["degree"], 0, False)]
    seen, frontier, found, cutoff, hubs = {root}, [root], None, False, 0
    last = budget.depth(depth)
    current = F.col("valid_to").isNull() | (F.col("valid_to") >= (F.current_date() if as_of is None else F.lit(as_of).cast("date")))
    for level in range(1, last + 1):
        if not frontier or len(seen) >= budget.max_nodes:
            cutoff |= strict and bool(frontier)
            break
        rows = expand(edges, entities, F.broadcast(spark.createDataFrame([(f,) for f in frontier], "from_id string")), budget.fanout, as_of, types, derived).persist()
        visited = F.broadcast(spark.createDataFrame([(v,) for v in seen], "to_id string"))
        best = F.min(F.struct("from_id", "rn", "entity_type", "display_name", "target_degree")).alias("b")
        fresh = rows.join(visited, "to_id", "left_anti").groupBy("to_id").agg(best).orderBy("b.from_id", "b.rn", "to_id")
        room = budget.max_nodes - len(seen)
        taken = fresh.limit(room + 1).collect()
        cutoff |= len(taken) > room or bool(rows.filter(F.col("matched_degree") > budget.fanout).limit(1).count())
        taken = taken[:room]
        seen |= {r["to_id"] for r in taken}
        nodes += [(r["to_id"], r["b"]["entity_type"], r["b"]["display_name"], r["b"]["target_degree"], level, level < last and r["b"]["target_degree"] > budget.hub_degree) for r in taken]
        visible = F.broadcast(spark.createDataFrame([(v,) for v in seen], "to_id string"))
        part = rows.join(visible, "to_id", "left_semi").select("id", *oriented(), "relationship_type", "valid_from", "valid_to", "confidence", current.alias("is_current"))
        found = part if found is None else found.unionByName(part)
        if level < last:
            frontier = [r["to_id"] for r in taken if r["b"]["target_degree"] <= budget.hub_degree]
            hubs += len(taken) - len(frontier)
    node_frame = spark.createDataFrame(nodes, "id string, entity_type string, display_name string, degree long, level int, truncated_expansion boolean")
    edge_frame = (found or spark.createDataFrame([], "id string, source_id string, target_id string, relationship_type string, valid_from date, valid_to date, confidence string, is_current boolean")).dropDuplicates(["id"])
    if collapse:
        node_frame, edge_frame = collapse_sole_traders(node_frame, edge_frame, root)
    meta = spark.createDataFrame([(root, last, cutoff, hubs)], "root string, depth int, truncated boolean, suppressed_hubs int")
    return Neighborhood(node_frame, edge_frame, meta)


def collapse_sole_traders(nodes: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Without persons, root excepted, whose only edge here says they are the company."""
    ends = edges.select("id", "relationship_type", F.explode(F.array("source_id", "target_id")).alias("node"))
    single = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("relationship_type").alias("only")).filter("n = 1 and only = 'sole_proprietor_of'")
    people = nodes.filter((F.col("entity_type") == "person") & (F.col("id") != root)).select(F.col("id").alias("node"))
    gone = single.join(people, "node", "left_semi").select("node")
    kept = edges.join(gone, edges["source_id"] == gone["node"], "left_anti").join(gone, edges["target_id"] == gone["node"], "left_anti")
    return nodes.join(gone, nodes["id"] == gone["node"], "left_anti"), kept


def sharing_address(relationships: DataFrame) -> DataFrame:
    """entity, address, entities: who is registered where more than one is, with how many are.

    Members and not pairs: a row for each link, whatever the size of its address.
    """
    live = relationships.filter(known() & (F.col("relationship_type") == "registered_at")).select(F.col("source_id").alias("entity"), F.col("target_id").alias("address")).distinct()
    sizes = live.groupBy("address").agg(F.count("*").alias("entities")).filter("entities > 1")
    return live.join(sizes, "address").select("entity", "address", "entities")
