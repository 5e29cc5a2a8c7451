"""Invariants of the graph, as checks that return their violations (subject)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions.temporal import known
from ledgerlink.operators.graph import degrees

Tables = dict[str, DataFrame]


def two_identifiers(t: Tables) -> DataFrame:
    live = t["entities"].filter("merged_into_id is null").select(F.col("id").alias("entity_id"))
    some = t["identifiers"].filter(F.col("scheme").isin("nip", "krs", "regon")).join(live, "entity_id", "left_semi")
    return some.groupBy("entity_id", "scheme").count().filter("count > 1").select(F.col("entity_id").alias("subject"))


def duplicate_addresses(t: Tables) -> DataFrame:
    from ledgerlink.operators.loading import address_groups

    return address_groups(t["addresses"]).filter("regions <= 1").select(F.concat_ws(" ", "city", "street", "building").alias("subject"))


def without_provenance(t: Tables) -> DataFrame:
    told = t["provenance"].select(F.col("relationship_id").alias("id")).distinct()
    return t["relationships"].join(told, "id", "left_anti").select(F.col("id").alias("subject"))


def many_addresses(t: Tables, most: int = 12) -> DataFrame:
    live = t["relationships"].filter(known() & (F.col("relationship_type") == "registered_at"))
    live = live.join(t["entities"].filter("merged_into_id is null").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return live.groupBy("source_id").count().filter(F.col("count") > most).select(F.col("source_id").alias("subject"))


def superseded_before_recorded(t: Tables) -> DataFrame:
    return t["relationships"].filter("superseded_on < recorded_on").select(F.col("id").alias("subject"))


def nameless(t: Tables) -> DataFrame:
    return t["entities"].filter("merged_into_id is null and (display_name is null or trim(display_name) = '')").select(F.col("id").alias("subject"))


def merged_with_edges(t: Tables) -> DataFrame:
    live = t["relationships"].filter(known())
    ends = live.select(F.col("source_id").alias("id")).unionByName(live.select(F.col("target_id").alias("id")))
    return t["entities"].filter("merged_into_id is not null").join(ends, "id", "left_semi").select(F.col("id").alias("subject"))


def stale_degrees(t: Tables) -> DataFrame:
    """Stored degrees that differ from a recount; entities without edges are not looked at."""
    true = degrees(t["relationships"]).withColumnRenamed("degree", "true")
    return t["entities"].join(true, "id").filter(~F.col("degree").eqNullSafe(F.col("true"))).select(F.col("id").alias("subject"))


@dataclass(frozen=True)
class Check:
    violations: Callable[[Tables], DataFrame]
    threshold: int = 0
    deep: bool = False


# How many violations each check lets pass.
CHECKS = {
    "entity_holds_one_identifier_per_scheme": Check(two_identifiers),
    "one_address_row_per_physical_address": Check(duplicate_addresses, 12032),
    "relationship_has_provenance": Check(without_provenance, 733),
    "company_is_not_registered_at_many_addresses": Check(many_addresses),
    "superseded_fact_is_not_older_than_its_record": Check(superseded_before_recorded),
    "entity_has_a_display_name": Check(nameless),
    "merged_entity_has_no_active_edges": Check(merged_with_edges),
    "degree_matches_actual_edge_count": Check(stale_degrees, deep=True),
}


def report(t: Tables, deep: bool = False) -> DataFrame:
    """check, violations, threshold, passed, sample (five subjects): one row a check."""
    out = None
    for name, c in CHECKS.items():
        if c.deep and not deep:
            continue
        found = c.violations(t)
        # Five subjects by order: a bounded top-k in every partial aggregate.
        head = found.orderBy("subject").limit(5).agg(F.concat_ws(",", F.sort_array(F.collect_list("subject"))).alias("sample"))
        row = found.agg(F.count("*").alias("violations")).crossJoin(F.broadcast(head))
        row = row.select(F.lit(name).alias("check"), "violations", F.lit(c.threshold).alias("threshold"), (F.col("violations") <= c.threshold).alias("passed"), "sample")
        out = row if out is None else out.unionByName(row)
    return out
