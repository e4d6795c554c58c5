"""Entity resolution: the outcome of one-at-a-time ingestion as a batch of joins.

Episodes are ordered by ``seq`` within a graph, entities of an episode by ``pos``.
The first occurrence of a name creates the entity and every other one merges into it.
A relationship sees the stored names and the names introduced up to its own episode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import keys
from loregraph.operators.scale import hint_if_small, in_slices, is_small
from loregraph.session import materialize

KEY = ["group_id", "name_lower"]
ALWAYS = -(1 << 63)  # stored names precede every episode


@dataclass
class Resolution:
    """Frames of one ingest; every frame is lazy and keyed by ``group_id``."""

    episodes: DataFrame
    entities: DataFrame
    mentions: DataFrame
    facts: DataFrame
    skipped: DataFrame
    counters: DataFrame


def place(seq: Column | str = "seq", pos: Column | str = "pos") -> Column:
    """(seq, pos) as one fixed-width number, so that its minimum is a hash aggregate."""
    wide = F.lit(str(10**19)).cast("decimal(20,0)")
    return (F.col(seq).cast("decimal(19,0)") * wide + F.col(pos).cast("decimal(19,0)")).cast("decimal(38,0)")


def first_places(occurrences: DataFrame) -> DataFrame:
    """Per name its first place; partial minima keep hot names small before the shuffle."""
    return occurrences.groupBy(*KEY).agg(F.min(place()).alias("first_place"), F.min("seq").alias("first_seq"))


def asked_names(occurrences: DataFrame, relations: DataFrame) -> DataFrame:
    """Every name a batch mentions or refers to, with its first place if it is mentioned."""
    ends = F.explode(F.array("source_key", "target_key")).alias("name_lower")
    nowhere = F.lit(None)
    rows = occurrences.select(*KEY, place().alias("place"), "seq").union(
        relations.select("group_id", ends, nowhere.cast("decimal(38,0)"), nowhere.cast("long"))
    )
    return rows.groupBy(*KEY).agg(F.min("place").alias("first_place"), F.min("seq").alias("first_seq"))


def stored_names(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """One stored uuid per asked name; of stored duplicates the oldest, then the lowest uuid.

    The stored side is lower-cased but not trimmed. The semi-join comes first, so only
    matching rows of a large graph are aggregated, and a small batch leaves the stored
    rows where they are.
    """
    keyed = stored.select("group_id", F.lower("name").alias("name_lower"), "uuid", "created_at")
    oldest = F.min(F.struct("created_at", "uuid"))["uuid"].alias("stored_uuid")
    return keyed.join(asked.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(oldest)


def dictionary(
    occurrences: DataFrame, relations: DataFrame, stored: DataFrame | None, staged: bool = False
) -> DataFrame:
    """One row per known name: its uuid, where it was first seen and whether it was stored before."""
    if stored is None:
        names = first_places(occurrences).withColumn("stored_uuid", F.lit(None).cast("string"))
    else:
        asked = asked_names(occurrences, relations)
        if staged:
            asked = materialize(asked)
        names = asked.join(stored_names(stored, asked), KEY, "left")
        names = names.filter("stored_uuid IS NOT NULL OR first_place IS NOT NULL")
    is_stored = F.col("stored_uuid").isNotNull()
    return names.select(
        *KEY,
        F.coalesce("stored_uuid", keys.entity_id(*KEY)).alias("entity_uuid"),
        is_stored.alias("is_stored"),
        "first_place",
        F.when(is_stored, F.lit(ALWAYS)).otherwise(F.col("first_seq")).alias("first_seq"),
    )


def resolve_occurrences(occurrences: DataFrame, names: DataFrame) -> DataFrame:
    """Every occurrence with its entity and whether it created it."""
    created = ~F.col("is_stored") & (place() == F.col("first_place"))
    return occurrences.join(names, KEY).select(*occurrences.columns, "entity_uuid", created.alias("created"))


def fresh_mentions(occurrences: DataFrame) -> DataFrame:
    """Mentions where nothing was stored before: ids follow from the names, so nothing is joined."""
    known = occurrences.filter("group_id IS NOT NULL AND name_lower IS NOT NULL")
    return new_mentions(known.withColumn("entity_uuid", keys.entity_id(*KEY)))


def resolve_relations(relations: DataFrame, names: DataFrame, fresh: bool = False) -> DataFrame:
    """Relationships with the uuids their endpoints had by then, NULL where unknown.

    With ``fresh`` names, none of which was stored before, the joins only tell which ends are known, and
    the ids are made after them instead of being shuffled."""
    joined = relations
    for end in ("source", "target"):
        found = F.col("first_seq" if fresh else "entity_uuid").alias(f"{end}_uuid")
        side = names.select(
            F.col("group_id").alias("_group"), F.col("name_lower").alias("_name"), F.col("first_seq").alias("_first"), found,
        )
        known = (
            (F.col("group_id") == F.col("_group")) & (F.col(f"{end}_key") == F.col("_name"))
            & (F.col("_first") <= F.col("seq"))
        )
        joined = joined.join(side, known, "left").drop("_group", "_name", "_first")
    return joined


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences that create their entity where nothing was stored before: those at the first place of their name.

    Every task keeps only its first ones of each name for the shuffle, which so follows the names."""
    placed = occurrences.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*KEY, "seq", "pos")))
    first = F.rank().over(Window.partitionBy(*KEY).orderBy("seq", "pos")).alias("_rank")
    return placed.select("*", first).filter("_rank = 1").drop("_rank").withColumns(
        {"entity_uuid": keys.entity_id(*KEY), "created": F.lit(True)})


def late_names(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Names that some relationship refers to before their first episode, or that have none. Any other is known to all."""
    ends = F.explode(F.array("source_key", "target_key")).alias("name_lower")
    asked = relations.select("group_id", "seq", ends).groupBy(*KEY).agg(F.min("seq").alias("_asked"))
    late = asked.join(names.select(*KEY, "first_seq"), KEY, "left").filter("first_seq IS NULL OR _asked < first_seq")
    return late.drop("_asked")


def resolve_late(relations: DataFrame, late: DataFrame) -> DataFrame:
    """What ``resolve_relations`` gives for fresh names, from the ``late`` ones alone; ends only tell if they are known."""
    joined = relations
    for end in ("source", "target"):
        side = late.select(F.col("group_id").alias("_group"), F.col("name_lower").alias("_name"), F.col("first_seq").alias("_first"), F.lit(True).alias("_late"))
        joined = joined.join(side, (F.col("group_id") == F.col("_group")) & (F.col(f"{end}_key") == F.col("_name")), "left")
        named = F.col("group_id").isNotNull() & F.col(f"{end}_key").isNotNull()
        known = named & (F.col("_late").isNull() | (F.col("_first") <= F.col("seq")))
        joined = joined.withColumn(f"{end}_uuid", F.when(known, F.col("seq"))).drop("_group", "_name", "_first", "_late")
    return joined


def linked_ids(linked: DataFrame) -> DataFrame:
    """``linked`` of fresh names with ids as uuids."""
    ends = {f"{end}_uuid": F.when(F.col(f"{end}_uuid").isNotNull(), keys.entity_id("group_id", f"{end}_key")) for end in ("source", "target")}
    return linked.withColumns(ends)


def new_entities(resolved: DataFrame) -> DataFrame:
    return resolved.filter("created").select(
        "group_id", F.col("entity_uuid").alias("uuid"), "name", "name_lower", "summary",
        F.array("label").alias("labels"), F.col("seq").alias("first_seq"),
    )


def new_mentions(resolved: DataFrame) -> DataFrame:
    return resolved.select("group_id", "episode_uuid", "pos", "entity_uuid")


def new_facts(linked: DataFrame) -> DataFrame:
    """Facts are never merged; structured facts carry no validity."""
    none = F.lit(None).cast("timestamp")
    return made_relations(linked).select(
        "group_id", keys.fact_id("episode_uuid", "pos").alias("uuid"), "source_uuid", "target_uuid",
        F.lit("RELATES_TO").alias("rel_type"), "name", "fact", F.array("episode_uuid").alias("episodes"),
        none.alias("valid_at"), none.alias("invalid_at"), none.alias("expired_at"),
    )


def made_relations(linked: DataFrame) -> DataFrame:
    return linked.filter("source_uuid IS NOT NULL AND target_uuid IS NOT NULL")


def skipped_relations(linked: DataFrame) -> DataFrame:
    return linked.filter("source_uuid IS NULL OR target_uuid IS NULL")


def ingest_counters(episodes: DataFrame, resolved: DataFrame, linked: DataFrame) -> DataFrame:
    """Counts per episode from one union of thin rows: one shuffle, zeroes for empty episodes."""
    created = F.col("created").cast("long")
    return _counted(episodes, linked, resolved.select("group_id", "episode_uuid", created.alias("made"), (1 - created).alias("merged")))


def first_counters(episodes: DataFrame, occurrences: DataFrame, first: DataFrame, linked: DataFrame) -> DataFrame:
    """The same from the ``first`` occurrences alone: every other one merges."""
    named = occurrences.filter(" AND ".join(f"{c} IS NOT NULL" for c in KEY))
    one = F.when(F.col("seq").isNotNull() & F.col("pos").isNotNull(), F.lit(1))
    return _counted(
        episodes, linked,
        named.select("group_id", "episode_uuid", (one * 0).alias("made"), one.alias("merged")),
        first.select("group_id", "episode_uuid", F.lit(1).alias("made"), F.lit(-1).alias("merged")),
    )


def _counted(episodes: DataFrame, linked: DataFrame, *entities: DataFrame) -> DataFrame:
    key = ["group_id", "episode_uuid"]
    made = F.col("source_uuid").isNotNull() & F.col("target_uuid").isNotNull()
    flags = ["entities_created", "entities_merged", "relationships_created", "relationships_skipped"]

    def row(df: DataFrame, **on: Column) -> DataFrame:
        return df.select(*key, *[on.get(f, F.lit(0)).cast("long").alias(f) for f in flags])

    rows = row(episodes).union(row(linked, relationships_created=made, relationships_skipped=~made))
    for each in entities:
        rows = rows.union(row(each, entities_created=F.col("made"), entities_merged=F.col("merged")))
    return rows.groupBy(*key).agg(*[F.sum(f).alias(f) for f in flags])


def resolve(
    episodes: DataFrame,
    occurrences: DataFrame,
    relations: DataFrame,
    stored: DataFrame | None = None,
    staged: bool = False,
) -> Resolution:
    """All frames of an ingest. ``staged`` writes the dictionary once for all of them; its
    size is then known, and it is broadcast only if it is small. If it is not and nothing was stored
    before, neither occurrences nor relationships are shuffled to meet it: who created an entity shows
    without it, and of the names only the late ones are looked up."""
    names = dictionary(occurrences, relations, stored, staged)
    fresh = stored is None
    if staged:
        names = materialize(names)
        small = is_small(names)
        if fresh and not small:
            first = materialize(*map(first_occurrences, in_slices(occurrences, *KEY)))
            linked = resolve_late(relations, hint_if_small(materialize(late_names(relations, names))))
            return _resolution(episodes, occurrences, first, linked, fresh, first_counters(episodes, occurrences, first, linked))
        names = F.broadcast(names) if small else names
    resolved = resolve_occurrences(occurrences, names)
    linked = resolve_relations(relations, names, fresh)
    return _resolution(episodes, occurrences, resolved, linked, fresh, ingest_counters(episodes, resolved, linked))


def _resolution(
    episodes: DataFrame, occurrences: DataFrame, resolved: DataFrame, linked: DataFrame, fresh: bool, counters: DataFrame
) -> Resolution:
    made, skipped = made_relations(linked), skipped_relations(linked)
    return Resolution(
        episodes=episodes,
        entities=new_entities(resolved),
        mentions=fresh_mentions(occurrences) if fresh else new_mentions(resolved),
        facts=new_facts(linked_ids(made) if fresh else made),
        skipped=linked_ids(skipped) if fresh else skipped,
        counters=counters,
    )
