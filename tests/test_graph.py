import pytest

from ledgerlink.operators import graph as G
from ledgerlink.operators import grid


def build(spark, edges, kinds=None):
    """Entities of all ends; an edge is (source, target, type, valid_from, valid_to)."""
    names = sorted({x for e in edges for x in e[:2]})
    rows = [(f"e{i:03d}", *e, None, "registered", 1.0) for i, e in enumerate(edges)]
    rel = spark.createDataFrame(rows, "id string, source_id string, target_id string, relationship_type string, valid_from string, valid_to string, superseded_on date, confidence string, confidence_score double")
    rel = rel.withColumns({c: rel[c].cast("date") for c in ("valid_from", "valid_to")})
    ents = spark.createDataFrame([(n, (kinds or {}).get(n, "company"), n, None) for n in names], "id string, entity_type string, display_name string, merged_into_id string")
    return G.both_ways(rel), G.refreshed_degrees(ents, rel)


def around(spark, edges, root, budget=G.Budget(), kinds=None, **more):
    n = G.neighborhood(*build(spark, edges, kinds), root, budget, **more)
    return {r["id"] for r in n.nodes.collect()}, {r["id"] for r in n.edges.collect()}, n.meta.first()


def test_chain(spark):
    nodes, edges, _ = around(spark, [("p", "a", "board_member_of", None, None), ("p", "b", "board_member_of", None, None)], "a", depth=2, as_of="2024-01-01", kinds={"p": "person"})
    assert nodes == {"a", "b", "p"} and len(edges) == 2


def test_as_of(spark):
    e = [("p", "a", "board_member_of", "2020-01-01", "2023-06-30")]
    assert len(around(spark, e, "a", as_of="2024-01-01")[0]) == 1
    assert len(around(spark, e, "a", as_of="2023-06-30")[0]) == 2
    assert len(around(spark, e, "a", as_of=None)[0]) == 2


def test_hub_and_budget(spark):
    hub = [("root", "hub", "registered_at", None, None), *[(f"s{i:02d}", "hub", "registered_at", None, None) for i in range(60)]]
    nodes, _, meta = around(spark, hub, "root", G.Budget(3, 300, 100, 20), depth=3)
    assert nodes == {"root", "hub"} and meta["suppressed_hubs"] == 1
    many = [("root", f"n{i:02d}", "parent_of", None, None) for i in range(40)]
    nodes, edges, meta = around(spark, many, "root", G.Budget(2, 10, 100, 150), depth=1)
    assert len(nodes) == 10 and len(edges) == 9 and meta["truncated"]


def test_sole_trader_collapses(spark):
    e = [("p", "a", "sole_proprietor_of", None, None), ("a", "b", "parent_of", None, None)]
    assert around(spark, e, "b", depth=2, kinds={"p": "person"})[0] == {"a", "b"}
    assert "p" in around(spark, e, "p", depth=2, kinds={"p": "person"})[0]


def test_depth():
    assert [p.depth(None) for p in G.PLANS.values()] == [1, 2, 2] and G.PLANS["pro"].depth(9) == 3


def test_grid(spark):
    points = spark.createDataFrame([("a", "A", 52240, 21240, None, 3), ("b", "B", 52245, 21245, None, 5), ("c", "C", None, None, None, 1)], "entity_id string, label string, lat int, lon int, merged_into_id string, degree int")
    cells = grid.base_cells(points)
    (r,) = grid.clusters(cells, 6).collect()
    assert (r["addresses"], r["entities"], r["lat"], r["lon"]) == (2, 8, 52242.5, 21242.5)
    assert grid.at_zoom(points, cells, 15, (52000, 21000, 53000, 22000), 1).columns[0] == "lat_idx"
    with pytest.raises(ValueError):
        grid.check_box((1, 1, 0, 2))
