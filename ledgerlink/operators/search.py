"""Staged entity search: identifier, exact, word prefix, words, prefix, surname, trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions import text as T

# Base and span of a stage's score, in the order of the stages.
BANDS = {"exact": (0.90, 0.09), "word_prefix": (0.70, 0.19), "words": (0.55, 0.14), "prefix": (0.40, 0.14)}
SURNAME, FUZZY, THRESHOLD, POOL = 0.35, (0.30, 0.09), 0.4, 300


# Weights of name length, register number, status and degree in a hit's relevance.
WEIGHTS, FULL_DEGREE = (0.40, 0.35, 0.15, 0.10), 20


def relevance(query: str) -> Column:
    """How well an entity answers, by name length, register number, status and degree."""
    length = F.least(F.lit(float(len(query))) / F.greatest(F.length("normalized_name"), F.lit(1)), F.lit(1.0))
    status = F.when(F.col("status") == "active", 1.0).when(F.col("status").isNull(), 0.5).otherwise(0.0)
    degree = F.least("degree", F.lit(FULL_DEGREE)) / float(FULL_DEGREE)
    return WEIGHTS[0] * length + WEIGHTS[1] * F.col("krs").isNotNull().cast("double") + WEIGHTS[2] * status + WEIGHTS[3] * degree


def conditions(query: str) -> dict[str, Column]:
    name, asked = F.col("normalized_name"), [w for w in query.split(" ") if w]
    return {
        "exact": name == query,
        "word_prefix": name.startswith(query + " "),
        "words": F.size(F.array_except(F.array(*[F.lit(w) for w in asked]), F.split(name, " "))) == 0,
        "prefix": name.startswith(query),
    }


HIT = ["id", "entity_type", "display_name", "degree", "score"]


def named(entities: DataFrame, companies: DataFrame, query: str, stage: str, limit: int = 20, pool: int = POOL, entity_type: str | None = None, **filters) -> DataFrame:
    """One name stage: the pool of highest degree, then filters on company columns, then the best by score."""
    return _named(entities, companies, query, stage, limit, pool, entity_type, **filters).select(HIT)


def _named(entities, companies, query, stage, limit, pool, entity_type=None, status=None, voivodeship=None, pkd=None) -> DataFrame:
    base, span = BANDS[stage]
    live = entities.filter(F.col("merged_into_id").isNull() & conditions(query)[stage])
    if entity_type is not None:
        live = live.filter(F.col("entity_type") == entity_type)
    live = live.orderBy(F.col("degree").desc(), "id").limit(pool)
    joined = _filtered(live.join(companies, live["id"] == companies["entity_id"], "left"), status, voivodeship, pkd)
    scored = joined.withColumn("score", F.round(F.lit(base) + relevance(query) * span, 6))
    return _best(scored, limit, F.col("score").desc(), F.length("normalized_name"), F.col("degree").desc(), "id")


def _best(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first rows of an order, with their place in it."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(*HIT, "place")


def _filtered(joined: DataFrame, status: str | None, voivodeship: str | None, pkd: str | None) -> DataFrame:
    if status is not None:
        joined = joined.filter(F.col("status") == status)
    if voivodeship is not None:
        joined = joined.filter(F.col("voivodeship") == voivodeship)
    if pkd is not None:
        joined = joined.filter(F.replace(F.col("pkd_main"), F.lit("."), F.lit("")).startswith(pkd.replace(".", "").upper()))
    return joined


def identifier_of(raw: str) -> str | None:
    """The digits of a query, if they are a valid NIP, REGON or KRS, however they are set apart."""
    d = "".join(c for c in raw if c.isdigit())
    total = lambda weights: sum(int(c) * w for c, w in zip(d, weights))
    if len(d) == 10:
        return d  # any ten digits can be a KRS
    nine = len(d) in (9, 14) and total(T.REGON_WEIGHTS[0]) % 11 % 10 == int(d[8])
    return d if nine and (len(d) == 9 or total(T.REGON_WEIGHTS[1]) % 11 % 10 == int(d[13])) else None


def identified(entities: DataFrame, identifiers: DataFrame, value: str, limit: int = 20) -> DataFrame:
    """Live entities that have the identifier, by id."""
    live = entities.filter("merged_into_id is null")
    hit = identifiers.filter(F.col("value") == value).select("entity_id").distinct()
    return live.join(hit, live["id"] == hit["entity_id"]).orderBy("id").limit(limit).select("id", "entity_type", "display_name", "degree", F.lit(1.0).alias("score"))


def by_surname(entities: DataFrame, people: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """People whose last name is the query's last word, of more than two letters."""
    surname = query.split(" ")[-1].upper()
    hit = people.filter(F.col("last_name") == surname) if len(surname) > 2 else people.limit(0)
    live = entities.filter("merged_into_id is null").join(hit.select("entity_id"), F.col("id") == F.col("entity_id"), "left_semi")
    return live.orderBy(F.col("degree").desc(), "id").limit(limit).select("id", "entity_type", "display_name", "degree", F.lit(SURNAME).alias("score"))


def fuzzy(entities: DataFrame, companies: DataFrame, query: str, limit: int = 20, threshold: float = THRESHOLD, entity_type: str | None = None, status: str | None = None, voivodeship: str | None = None, pkd: str | None = None) -> DataFrame:
    """Names that share enough trigrams with the query. The query's set is a literal, so this is one scan."""
    live = entities.filter("merged_into_id is null")
    if entity_type is not None:
        live = live.filter(F.col("entity_type") == entity_type)
    live = live.withColumn("similarity", T.similarity(F.col("normalized_name"), query)).filter(F.col("similarity") >= threshold)
    joined = _filtered(live.join(companies, live["id"] == companies["entity_id"], "left"), status, voivodeship, pkd)
    scored = joined.withColumn("score", F.round(F.lit(FUZZY[0]) + F.col("similarity") * FUZZY[1], 6))
    return scored.orderBy(F.col("score").desc(), F.col("degree").desc(), "id").limit(limit).select("id", "entity_type", "display_name", "degree", "score")


# How many hits are seen before a page is sorted by anything but relevance, and the keys for it.
SORT_POOL = 200
SORT_KEYS = ("relevance", "degree", "name", "registered", "city", "status")
#: Company columns that a hit carries, where the table has them.
DETAILS = ("nip", "krs", "status", "city", "voivodeship", "registered_on", "pkd_main")


def _sorted_by(key: str) -> list[Column]:
    """Unknown values last; ties stay in the order of relevance."""
    name = F.lower(F.coalesce("display_name", F.lit("")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return {
        "relevance": [],
        "degree": [F.col("degree").desc(), name],
        "name": [name],
        "registered": [F.col("registered_on").desc_nulls_last()],
        "city": [blank("city"), F.lower("city")],
        "status": [blank("status"), F.col("status")],
    }[key]


def search(entities: DataFrame, companies: DataFrame, identifiers: DataFrame, people: DataFrame, raw: str, query: str, limit: int = 20, offset: int = 0, force_fuzzy: bool = False, entity_type: str | None = None, sort: str = "relevance", **filters) -> DataFrame:
    """A page of hits: rank, id, entity_type, display_name, degree, score, stage, has_more and DETAILS.

    Stages follow each other: the identifier in the query (raw), if its digits
    are one, whatever the filters; the four name stages; surnames; and trigrams
    if asked for, or if nothing else is found, the one decision made on the
    driver. An id keeps its first stage, and a stage takes part while those
    before it have found too few. Sorted by another key than relevance, the page
    is cut from a pool of SORT_POOL hits. has_more is on every row.
    """
    need = offset + limit + 1 if sort == "relevance" else max(offset + limit + 1, SORT_POOL)
    stages, by_degree = [], (F.col("degree").desc(), F.col("id"))
    if number := identifier_of(raw):
        stages.append(_best(identified(entities, identifiers, number, need), need, F.col("id")).withColumn("stage", F.lit(0)))
    stages += [_named(entities, companies, query, s, need, max(POOL, need), entity_type, **filters).withColumn("stage", F.lit(i)) for i, s in enumerate(BANDS, 1)]
    if entity_type in (None, "person") and not filters.get("voivodeship") and not filters.get("pkd"):
        stages.append(_best(by_surname(entities, people, query, need), need, *by_degree).withColumn("stage", F.lit(5)))
    union = lambda parts: [x := parts[0], *[x := x.unionByName(p) for p in parts[1:]]][-1]
    if len(query) >= 3 and (force_fuzzy or union(stages).isEmpty()):
        likely = fuzzy(entities, companies, query, need, entity_type=entity_type, **filters)
        stages.append(_best(likely, need, F.col("score").desc(), *by_degree).withColumn("stage", F.lit(6)))
    # At most seven stages of `need` rows are left, so one task ranks them.
    own = Window.partitionBy("id").orderBy("stage", "place")
    hits = union(stages).withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")
    before = F.count("*").over(Window.orderBy("stage").rangeBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("before", before).filter((F.col("before") < need) & ((F.col("stage") != 5) | (F.col("place") <= need - F.col("before"))))
    hits = hits.withColumn("found", F.row_number().over(Window.orderBy("stage", "place")))
    known = [c for c in DETAILS if c in companies.columns]
    hits = hits.join(companies.select(F.col("entity_id").alias("of"), *known), F.col("id") == F.col("of"), "left")
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*_sorted_by(sort), "found")))
    more = ranked.agg((F.max("rank") > offset + limit).alias("has_more"))
    page = ranked.filter(F.col("rank").between(offset + 1, offset + limit)).crossJoin(F.broadcast(more))
    return page.select("rank", *HIT, "stage", "has_more", *known)


# Keys by which any table of hits can be sorted, missing values last.
SORTS = {
    "relevance": ["rank"],
    "name": ["display_name", "id"],
    "degree": [("degree", False), "id"],
    "registered": [("registered_on", False), "id"],
}


def resorted(hits: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else F.col(c[0]).desc_nulls_last() for c in SORTS[key]]
    return hits.orderBy(*order).offset(offset).limit(limit)
