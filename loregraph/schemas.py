"""Fixed schemas of the request frames and of the stored tables."""

from pyspark.sql import types as T

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PROPERTIES = T.MapType(_S, _S)

# --- requests -------------------------------------------------------------
EPISODE_REQUEST = _struct(
    client_slug=_S, engagement_id=_S, episode_type=_S, content=_S, source_id=_S, source_type=_S,
    metadata=PROPERTIES, timestamp=_TS, ingest_seq=_L,
)
BOOTSTRAP_REQUEST = _struct(
    client_slug=_S, engagement_id=_S, documents=T.ArrayType(PROPERTIES), ingest_seq=_L,
)
ENTITY = _struct(name=_S, type=_S, description=_S)
RELATIONSHIP = _struct(source=_S, target=_S, relation=_S, fact=_S)
STRUCTURED_REQUEST = _struct(
    client_slug=_S, episode_name=_S, source_description=_S, reference_time=_TS,
    entities=T.ArrayType(ENTITY), relationships=T.ArrayType(RELATIONSHIP), ingest_seq=_L,
)
SEARCH_REQUEST = _struct(
    query_id=_L, client_slug=_S, engagement_id=_S, query=_S, max_results=T.IntegerType(),
    include_segment=T.BooleanType(), industry=_S,
)
ADMIN_REQUEST = _struct(client_slug=_S, confirm=_S)
FINDING = _struct(title=_S, content=_S, type=_S, client_name=_S, known_names=T.ArrayType(_S))

# --- stored tables (partition columns last) --------------------------------
_PARTITIONS = {"group_id": _S, "batch_id": _S}
TABLES = {
    "episodes": _struct(
        uuid=_S, name=_S, content=_S, source=_S, source_description=_S, valid_at=_TS,
        created_at=_TS, ingest_seq=_L, **_PARTITIONS,
    ),
    "entities": _struct(
        uuid=_S, name=_S, name_lower=_S, summary=_S, labels=T.ArrayType(_S), created_at=_TS,
        first_seq=_L, properties=PROPERTIES, **_PARTITIONS,
    ),
    "mentions": _struct(episode_uuid=_S, pos=_L, entity_uuid=_S, created_at=_TS, **_PARTITIONS),
    "facts": _struct(
        uuid=_S, source_uuid=_S, target_uuid=_S, rel_type=_S, name=_S, fact=_S,
        episodes=T.ArrayType(_S), created_at=_TS, valid_at=_TS, invalid_at=_TS, expired_at=_TS,
        **_PARTITIONS,
    ),
}
GRAPHS = _struct(kind=_S, created_at=_TS, group_id=_S)
BATCHES = _struct(committed_at=_TS, batch_id=_S)
