"""Semi-structured attributes, histories and ranks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; new wins. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def allowed(attributes: Column, keys: list[str], longest: int = 500) -> Column:
    """Of attributes the keys named, without empty values, cut to a length; '<key>_truncated' tells."""
    kept = F.map_filter(attributes, lambda k, v: k.isin(*keys) & v.isNotNull() & (v != ""))
    cut = F.transform_values(kept, lambda _, v: F.substring(v, 1, longest))
    long = F.map_filter(kept, lambda _, v: F.length(v) > longest)
    return F.map_concat(cut, F.map_from_entries(F.transform(F.map_keys(long), lambda k: F.struct(F.concat(k, F.lit("_truncated")), F.lit("true")))))


def without_nulls(*columns: Column) -> Column:
    """A JSON object of the columns that are not null."""
    return F.to_json(F.struct(*columns))


def redacted(json: Column, pepper: str, field: str = "pesel") -> Column:
    """JSON with every value of a field, at any depth, hashed, or null if it is no such number."""
    import json as J
    import re
    from hashlib import blake2b

    import pandas as pd

    def clean(x):
        if isinstance(x, dict):
            return {k: hashed(v) if k.lower() == field and v is not None else clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def hashed(v):
        digits = re.sub(r"\D", "", str(v))
        return blake2b(f"{pepper}:{digits}".encode(), digest_size=16).hexdigest() if len(digits) == 11 else None

    def every(s: pd.Series) -> pd.Series:
        return s.map(lambda v: J.dumps(clean(J.loads(v)), ensure_ascii=False) if v else None)

    return F.pandas_udf(every, "string")(json)


def nearest_rank(df: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """key, p50, ...: of each key's values in order the one at rank ceil(p / 100 n)."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value))).join(df.groupBy(key).agg(F.count("*").alias("_n")), key)
    at = lambda p: F.max(F.when(F.col("_r") == F.greatest(F.ceil(F.col("_n") * p / 100), F.lit(1)), F.col(value))).alias(f"p{p}")
    return ranked.groupBy(key).agg(*[at(p) for p in percents])


def after(df: DataFrame, key: str, last: object, limit: int) -> DataFrame:
    """The next rows of a work list, by key, after the last one done."""
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def has_more(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page, and whether rows follow it: one row more than the page is looked for."""
    page = df.orderBy(*order).offset(offset)
    return page.limit(limit), page.limit(limit + 1).count() > limit


def in_parallel(df: DataFrame, *arrays: str) -> DataFrame:
    """One row for each place of arrays of equal length."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*rest, *[F.col(f"_z.{a}").alias(a) for a in arrays])
