"""Column masks and the row filter, as pure column expressions."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import OVERSIGHT_GROUP, PII_REVIEWERS, TEAM_GROUP_PREFIX


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, "^[^@]+", "****")


def mask_phone(c: Column) -> Column:
    return F.concat(F.lit("*******"), F.right(c, F.lit(3)))


def mask_dob(c: Column) -> Column:
    return F.trunc(c, "YEAR")


def mask_addr(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("*** REDACTED ***"))


# Identifiers used by entity resolution stay clear on purpose.
POLICY: Mapping[str, Mapping[str, Callable[[Column], Column]]] = {
    "customers": {
        "email": mask_email,
        "phone": mask_phone,
        "dob": mask_dob,
        "address": mask_addr,
    },
    "third_parties": {"address": mask_addr},
}


def apply_masks(
    df: DataFrame,
    policy: Mapping[str, Callable[[Column], Column]],
    groups: Collection[str] = (),
) -> DataFrame:
    """Mask the policy's columns unless the reader is a PII reviewer."""
    if PII_REVIEWERS in groups:
        return df
    return df.withColumns({name: mask(F.col(name)) for name, mask in policy.items()})


def row_filter(df: DataFrame, groups: Collection[str], team_col: str = "team_id") -> DataFrame:
    """Rows a reader may see: all for oversight, else the reader's own teams."""
    if OVERSIGHT_GROUP in groups:
        return df
    own = [g.removeprefix(TEAM_GROUP_PREFIX) for g in groups if g.startswith(TEAM_GROUP_PREFIX)]
    return df.filter(F.lower(team_col).isin(own))
