"""Entity and fact extraction from text with a gazetteer of known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import text
from loregraph.operators.scale import first_wins, hint_if_small, of_groups, spread
from loregraph.session import materialize

EPISODE = ["group_id", "episode_uuid", "seq"]
# A position is a sentence, the token it starts at and its number of tokens in one number:
# 24, 27 and 12 bits. Longer names are no names, more sentences or tokens fail instead of wrapping.
MAX_NAME_TOKENS = (1 << 12) - 1
MAX_STARTS = 1 << 27
# A name is sought by its first tokens: so many, or all of a shorter one.
HEAD = 3


def gazetteer(terms: DataFrame) -> DataFrame:
    """(group_id, name, type) rows as one row per (group_id, token key); the lowest name wins.

    Without a ``group_id`` column the terms apply to every graph. Names of more than ``MAX_NAME_TOKENS``
    tokens are left out; ``refused_names`` has them.
    """
    keep = [c for c in ("group_id", "name", "type") if c in terms.columns]
    keyed = terms.select(*keep, text.token_key("name").alias("gram")).filter("gram <> ''")
    keyed = keyed.filter(F.size(F.split("gram", " ")) <= MAX_NAME_TOKENS)
    if "type" not in keep:
        keyed = keyed.withColumn("type", F.lit("Entity"))
    return first_wins(keyed, [c for c in ("group_id", "gram") if c in keyed.columns], ["name", "type"])


def refused_names(terms: DataFrame) -> DataFrame:
    """Terms that a gazetteer cannot hold, with the ``reason``."""
    n = F.size(text.tokens("name"))
    reason = F.when(F.col("name").isNull() | (n == 0), "no token").when(n > MAX_NAME_TOKENS, f"more than {MAX_NAME_TOKENS} tokens")
    return terms.withColumn("reason", reason).filter("reason IS NOT NULL")


def graph_names(stored: DataFrame, episodes: DataFrame) -> DataFrame:
    """Names already in the graphs of ``episodes``, as gazetteer terms of their own graph."""
    return of_groups(stored.select("group_id", "name"), episodes).filter("name IS NOT NULL").distinct()


def sentence_rows(episodes: DataFrame) -> DataFrame:
    """One row per non-empty sentence, numbered within its text."""
    each = spread(episodes.select(*EPISODE, "content"), "episode_uuid").select(
        *EPISODE, F.posexplode(text.sentences("content")).alias("sent", "sentence")
    )
    return each.filter("sentence <> ''")


def headed(names: DataFrame, source: int = 0) -> DataFrame:
    """Gazetteer rows with ``head``, a hash of their first tokens (and of their graph, if they belong to one),
    the number of tokens in it (``size``), and all ``tokens``."""
    scoped = "group_id" in names.columns
    scope = F.col("group_id") if scoped else F.lit(None).cast("string")
    rows = names.select(scope.alias("scope"), "gram", "name", "type", F.split("gram", " ").alias("tokens")).withColumn("size", F.least(F.lit(HEAD), F.size("tokens")))
    head = F.lit(None).cast("long")
    for size in range(1, HEAD + 1):
        head = F.when(F.col("size") == size, _head(F.col("tokens"), F.lit(0), size, F.col("scope"))).otherwise(head)
    return rows.withColumn("head", head).withColumn("scoped", F.lit(scoped)).withColumn("source", F.lit(source))


def _head(words: Column, start: Column, size: int, scope: Column) -> Column:
    return F.xxhash64(scope, *[F.get(words, start + i) for i in range(size)])


def _no_heads() -> Column:
    return F.array().cast("array<struct<start:int,head:bigint>>")


def _heads(scoped: bool, size: int) -> Column:
    """(start, head) of every ``size`` neighbouring words of a sentence."""
    scope = F.col("group_id") if scoped else F.lit(None).cast("string")
    starts = F.sequence(F.lit(0), F.size("words") - size)
    every = F.transform(starts, lambda i: F.struct(i.alias("start"), _head(F.col("words"), i, size, scope).alias("head")))
    return F.when(F.size("words") >= size, every).otherwise(_no_heads())


def sightings(episodes: DataFrame, *gazetteers: DataFrame) -> DataFrame:
    """First place of every gazetteer name in every sentence; of a name in several gazetteers, the first counts.

    The texts are read once for all gazetteers. What is exploded per token is a hash of the next tokens
    and its place; only where a name begins with the same hash are tokens compared, so the work does
    not depend on how long names are or how many lengths there are. Gazetteers shown to be small are
    broadcast; larger ones meet the hashes in a shuffle, and what is left of those its sentence.
    """
    names = headed(gazetteers[0])
    for source, more in enumerate(gazetteers[1:], 1):
        names = names.unionByName(headed(more, source))
    names = materialize(names)
    kinds = names.select("scoped", "size").distinct().collect()
    words = sentence_rows(episodes).select(*EPISODE, "sent", text.tokens("sentence").alias("words"))
    found = [_no_heads(), *(_heads(scoped, size) for scoped, size in sorted(map(tuple, kinds)))]
    each = words.select(*EPISODE, "sent", "words", F.explode(F.concat(*found)).alias("h")).select(*EPISODE, "sent", "words", "h.start", "h.head")
    asked = hint_if_small(names)
    if asked is names:
        met = each.drop("words").join(names.select("head").distinct(), "head", "left_semi")
        each = met.join(words, [*EPISODE, "sent"])
    seen = each.join(asked, "head").filter(F.col("scope").isNull() | (F.col("scope") == F.col("group_id")))
    seen = seen.filter(F.slice("words", F.col("start") + 1, F.size("tokens")) == F.col("tokens"))
    place = F.when(F.col("start") < MAX_STARTS, F.col("start").cast("long") * F.lit(MAX_NAME_TOKENS + 1) + F.size("tokens"))
    seen = seen.select(*EPISODE, "sent", "gram", "name", "type", "source",
                       F.coalesce(place, F.raise_error(F.lit("a sentence is too long"))).alias("place"))
    return first_wins(seen, [*EPISODE, "sent", "gram"], ["source", "place", "name", "type"]).drop("source")


def position() -> Column:
    """Sentence and place as one number, in the order of the text."""
    return F.col("sent").cast("long") * F.lit((MAX_NAME_TOKENS + 1) * MAX_STARTS) + F.col("place")


def entity_rows(seen: DataFrame) -> DataFrame:
    """One entity row per episode and name, at its first place in the text."""
    pos = F.min(position()).alias("pos")
    return seen.groupBy(*EPISODE, "gram", "name", "type").agg(pos).select(
        *EPISODE, "pos", "name", "type", F.lit("").alias("description")
    )


def relationship_rows(seen: DataFrame, sentences: DataFrame) -> DataFrame:
    """Each name linked to the next one in its sentence; the fact is the sentence.

    Neighbours rather than all pairs: the number of facts grows with the text, not with
    its square. A window never holds more than the names of one sentence of one text. The
    sentences join once, at the end.
    """
    inside = Window.partitionBy(*EPISODE, "sent").orderBy("place", "gram")
    linked = seen.withColumn("target", F.lead("name").over(inside)).filter("target IS NOT NULL")
    return linked.join(sentences, [*EPISODE, "sent"]).select(
        *EPISODE, position().alias("pos"), F.col("name").alias("source"), "target", F.lit("relates_to").alias("relation"),
        F.col("sentence").alias("fact"),
    )


def extract(episodes: DataFrame, terms: DataFrame | None, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity rows, relationship rows) in the shape of structured requests.

    Names come from ``terms`` and from the graphs (``stored`` entities); where both have one, the
    term's spelling and type are taken. What was seen is written once, instead of a pass over the
    text for each later use.
    """
    known = [gazetteer(terms)] if terms is not None else []
    if stored is not None:
        known.append(gazetteer(graph_names(stored, episodes)))
    seen = materialize(sightings(episodes, *known))
    return entity_rows(seen), relationship_rows(seen, sentence_rows(episodes))
