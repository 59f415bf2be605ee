"""Site identity: domains of property names, duplicate scopes, and matching names of different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import scope_domain, scope_id


def with_domain(scopes: DataFrame, site: str = "site") -> DataFrame:
    return scopes.withColumn("domain", scope_domain(F.col(site))).withColumn("scope_id", scope_id(F.col("owner"), F.col("domain")))


def duplicates(scopes: DataFrame) -> DataFrame:
    return scopes.groupBy("owner", "domain").agg(F.count(F.lit(1)).alias("scopes")).filter("scopes > 1")


def merged(scopes: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The oldest scope of each owner and domain, and the children pointed to it (repeats dropped)."""
    own = Window.partitionBy("owner", "domain").orderBy("created_at", "id")
    kept = scopes.withColumn("_kept", F.first("id").over(own))
    moved = children.join(kept.select(F.col("id").alias("scope"), "_kept"), "scope").select(F.col("_kept").alias("scope"), *[c for c in children.columns if c != "scope"]).distinct()
    return kept.filter("id = _kept").drop("_kept"), moved


def names_of(name: Column) -> Column:
    """What a property may be called: its domain, and the domain's first label without hyphens."""
    domain = scope_domain(name)
    return F.array_distinct(F.array(domain, F.regexp_replace(F.split(domain, r"\.")[0], "-", "")))


def matched(sites: DataFrame, properties: DataFrame) -> DataFrame:
    """site, property of the same owner that share a name; equal domains first, one property for each site."""
    a = sites.select("owner", "site", F.explode(names_of(F.col("site"))).alias("name"), scope_domain(F.col("site")).alias("_d"))
    b = properties.select("owner", "property", F.explode(names_of(F.col("property"))).alias("name"), scope_domain(F.col("property")).alias("_e"))
    both = a.join(b, ["owner", "name"]).groupBy("owner", "site", "property").agg(F.max((F.col("_d") == F.col("_e")).cast("int")).alias("exact"))
    own = Window.partitionBy("owner", "site").orderBy(F.desc("exact"), "property")
    return both.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").drop("_rn")


def visible(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows whose owner and site are granted: a semi join, which prunes where the table is partitioned by them."""
    return rows.join(grants.select("owner", "site").distinct(), ["owner", "site"], "left_semi")


def property_access(activated: DataFrame, mapped: DataFrame, stored: DataFrame) -> DataFrame:
    """owner, property, grounds: how many of the three sources know the property."""
    one = lambda df: df.select("owner", "property").distinct()
    return one(activated).unionByName(one(mapped)).unionByName(one(stored)).groupBy("owner", "property").agg(F.count(F.lit(1)).alias("grounds"))
