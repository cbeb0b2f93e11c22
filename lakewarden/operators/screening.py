"""Fuzzy watchlist screening.

A pair is kept at similarity 0.82 after a 0.05 bonus for equal sound, so a pair
can only qualify when its edit distance is at most 23.05 % of the longer name
(0.77 less half a unit of the third decimal). Both candidate joins below use
that bound, are equi-joins and lose no pair:

* a list of checked size is broadcast and meets names of compatible length only;
* a longer list is cut into ``d + 1`` pieces per name, where ``d`` is the
  distance bound: with at most ``d`` edits one piece survives unedited, so the
  join runs on (length, piece number, piece text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.scoring import lookup

# Confidence floor, sound bonus and the "probable" band.
FLOOR = 0.82
SOUND_BONUS = 0.05
PROBABLE = 0.90

SMALL_LIST_ROWS = 20_000
#: Pieces of a longer list that are broadcast to meet the names where they lie, at most.
MAX_BROADCAST_PIECES = 500_000


def _reach(floor: float) -> float:
    """Largest edit distance, as a share of the longer name, that can still pass."""
    return 1.0 - (floor - SOUND_BONUS - 0.0005)


def _bound(length: Column, share: float) -> Column:
    return F.floor(length * share + 1e-9).cast("int")


def _lengths(length: Column, share: float) -> tuple[Column, Column]:
    """Shortest and longest compatible name for a list name of ``length``."""
    return (
        F.greatest(F.lit(1), F.ceil(length * (1 - share) - 1e-9)).cast("int"),
        F.floor(length / (1 - share) + 1e-9).cast("int"),
    )


def _by_length(names: DataFrame, listed: DataFrame, share: float) -> DataFrame:
    shortest, longest = _lengths(F.length("w_low"), share)
    spread = listed.withColumn("len", F.explode(F.sequence(shortest, longest)))
    return names.join(F.broadcast(spread), "len")


def _by_piece(names: DataFrame, listed: DataFrame, share: float) -> DataFrame:
    """Candidates that share one unedited piece at a position the edits allow.

    The bound depends on both lengths, so pieces are cut per (list length, name
    length) pair; only pairs of lengths that occur are enumerated, and these few shapes
    are broadcast, as most names may have one length. Counted pieces are broadcast too,
    so that the probes of a name are made and compared where the name lies.
    """
    size = F.length("w_low")
    shortest, longest = _lengths(size, share)
    spread = (
        listed.withColumn("w_len", size)
        .withColumn("len", F.explode(F.sequence(shortest, longest)))
        .withColumn("edits", _bound(F.greatest("w_len", "len"), share))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    at, step = F.col("piece"), F.col("edits") + 1
    start = F.floor(at * F.col("w_len") / step).cast("int")
    stop = F.floor((at + 1) * F.col("w_len") / step).cast("int")
    pieces = spread.withColumns({"start": start, "width": stop - start}).withColumn(
        "text", F.col("w_low").substr(F.col("start") + 1, F.col("width"))
    )
    shapes = pieces.select("len", "w_len", "piece", "edits", "start", "width").distinct()
    first = F.greatest(F.lit(0), F.col("start") - F.col("edits"))
    last = F.least(F.col("len") - F.col("width"), F.col("start") + F.col("edits"))
    probes = (
        names.join(F.broadcast(shapes), "len")
        .filter(last >= first)
        .withColumn("at", F.explode(F.sequence(first, last)))
        .select(
            *names.columns, "w_len", "piece",
            F.col("e_low").substr(F.col("at") + 1, F.col("width")).alias("text"),
        )
    )
    cut = pieces.select(*listed.columns, "len", "w_len", "piece", "text")
    if cut.limit(MAX_BROADCAST_PIECES + 1).count() <= MAX_BROADCAST_PIECES:
        cut = F.broadcast(cut)
    else:
        probes = probes.distinct()
    hits = probes.join(cut, ["len", "w_len", "piece", "text"])
    return hits.select(*names.columns, *listed.columns).distinct()


def screen_names(
    entities: DataFrame,
    watchlist: DataFrame,
    floor: float = FLOOR,
    small_list_rows: int = SMALL_LIST_ROWS,
) -> DataFrame:
    """Scored hits of entity names against a watchlist.

    Distinct names are compared once and joined back to their entities. The list
    is broadcast only after its size was counted; a longer list takes the piece
    join.
    """
    share = _reach(floor)
    listed = watchlist.select(
        "watchlist_id", "watch_name", "list_type", "list_source", "reason", "severity",
        F.lower("watch_name").alias("w_low"),
    ).filter(F.length("w_low") > 0)
    names = (
        entities.filter(F.length("full_name") > 0)
        .select(F.col("full_name").alias("entity_name"))
        .distinct()
        .withColumn("e_low", F.lower("entity_name"))
        .withColumn("len", F.length("e_low"))
    )
    small = len(listed.select("watchlist_id").take(small_list_rows + 1)) <= small_list_rows
    pairs = _by_length(names, listed, share) if small else _by_piece(names, listed, share)

    longer = F.greatest(F.length("entity_name"), F.length("watch_name"))
    widest = F.greatest(F.length("e_low"), F.length("w_low"), longer)
    bound = F.ceil(widest * share).cast("int")
    distance = F.call_function("levenshtein", F.col("e_low"), F.col("w_low"), bound)
    same_sound = F.soundex("entity_name") == F.soundex("watch_name")
    scored = (
        pairs.withColumn("distance", distance)
        .filter(F.col("distance") >= 0)  # -1: the bound was exceeded
        .withColumn("similarity", F.round(1.0 - F.col("distance") / longer.cast("double"), 3))
        .withColumn("exact_match", F.col("e_low") == F.col("w_low"))
        .withColumn(
            "match_score",
            F.least(
                F.lit(1.0),
                F.round(F.col("similarity") + F.when(same_sound, SOUND_BONUS).otherwise(0.0), 3),
            ),
        )
        .filter(F.col("exact_match") | (F.col("match_score") >= floor))
    )
    confidence = (
        F.when(F.col("exact_match"), "confirmed")
        .when(F.col("match_score") >= PROBABLE, "probable")
        .otherwise("possible")
    )
    parties = entities.select(
        "entity_id", "source_id", "party_type", F.col("full_name").alias("entity_name"),
        F.col("country").alias("entity_country"),
    ).distinct()
    return scored.join(parties, "entity_name").select(
        F.concat_ws("-", F.lit("SCR"), "entity_id", "watchlist_id").alias("screening_id"),
        "entity_id", "source_id", "party_type", "entity_name", "entity_country",
        "watchlist_id", "watch_name", "list_type", "list_source", "reason", "severity",
        "match_score", "exact_match", confidence.alias("confidence"),
    )


def screening_list(hits: DataFrame, confidence: str | None = None, limit: int = 100) -> DataFrame:
    """Strongest hits first: confidence band, then score."""
    if confidence:
        hits = hits.filter(F.col("confidence") == confidence)
    band = lookup(F.col("confidence"), {"confirmed": 0, "probable": 1}, 2)
    return hits.orderBy(band, F.desc("match_score"), "screening_id", "source_id").limit(limit)


def screening_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("list_type", "confidence").agg(F.count("*").alias("hits"))
