"""Entity resolution: customers and third parties to one party id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import SkewPolicy
from lakewarden.operators.ranking import dense_rank
from lakewarden.operators.skew import join_unique

_PARTY = ["source_id", "party_type", "full_name", "national_id", "tax_number", "city", "country"]


def parties(customers: DataFrame, third_parties: DataFrame) -> DataFrame:
    """Both party tables in one shape; third parties have no birth date."""
    people = customers.select(
        F.col("customer_id").alias("source_id"), F.lit("customer").alias("party_type"),
        *_PARTY[2:], "dob",
    )
    firms = third_parties.select(
        F.col("third_party_id").alias("source_id"), F.lit("third_party").alias("party_type"),
        *_PARTY[2:],
    )
    return people.unionByName(firms, allowMissingColumns=True)


def det_key(national_id: Column, tax_number: Column) -> Column:
    """Identifier key; the prefixes keep both identifier kinds apart, '' is missing."""
    tagged = [
        F.concat(F.lit(tag), F.nullif(ident, F.lit("")))
        for tag, ident in (("NID:", national_id), ("TAX:", tax_number))
    ]
    return F.coalesce(*tagged)


def fuzzy_key(full_name: Column, city: Column) -> Column:
    """Sound of the name plus city, the fallback when no identifier is known."""
    known = [F.coalesce(c, F.lit("")) for c in (full_name, city)]
    return F.concat_ws("|", F.soundex(known[0]), F.upper(known[1]))


def cluster_key(df: DataFrame) -> DataFrame:
    keys = det_key(F.col("national_id"), F.col("tax_number"))
    return df.withColumn(
        "cluster_key", F.coalesce(keys, fuzzy_key(F.col("full_name"), F.col("city")))
    )


def resolve_entities(
    customers: DataFrame,
    third_parties: DataFrame,
    id_mode: str = "dense",
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Parties with ``entity_id``, ``cluster_key`` and ``cluster_size``.

    ``dense`` numbers the clusters in key order (every new party may renumber);
    ``hash`` derives a stable id from the key. Cluster sizes come from a combined
    count and one key-unique join, never from a window over a whole cluster.
    """
    keyed = cluster_key(parties(customers, third_parties))
    sizes = keyed.groupBy("cluster_key").agg(F.count("*").alias("cluster_size"))
    if id_mode == "hash":
        ident = F.concat(F.lit("ENT"), F.sha2("cluster_key", 256).substr(1, 16))
        clusters = sizes.withColumn("entity_id", ident)
    else:
        digits = F.col("n").cast("string")
        number = F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0"))
        ranked = dense_rank(sizes, "cluster_key", "n")
        clusters = sizes.join(ranked, "cluster_key").select(
            "cluster_key", "cluster_size", F.concat(F.lit("ENT"), number).alias("entity_id")
        )
    return join_unique(keyed, clusters, "cluster_key", "cluster_size", policy).select(
        "entity_id", *_PARTY, "dob", "cluster_key", "cluster_size"
    )


def entity_map(entities: DataFrame) -> DataFrame:
    return entities.select("source_id", "party_type", "entity_id", "cluster_size")
