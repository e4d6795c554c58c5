"""Id, name and property expressions of graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.functions.keys import _col

# Properties left out of the exported view.
SKIPPED_PROPERTIES = [
    "uuid", "id", "name", "label", "content", "name_embedding", "entity_edges", "source",
]


def node_id(properties: Column | str, native_id: Column | str) -> Column:
    """First *present* id; a present empty uuid is kept."""
    props = _col(properties)
    return F.coalesce(props["uuid"], props["id"], _col(native_id).cast("string"))


def node_name(properties: Column | str, native_id: Column | str) -> Column:
    props = _col(properties)
    return F.coalesce(
        props["name"], props["label"], F.concat(F.lit("Node "), _col(native_id).cast("string"))
    )


def endpoint_id(uuid: Column | str, other_id: Column | str, native_id: Column | str) -> Column:
    """First *non-empty* id; unlike ``node_id`` an empty uuid falls through."""
    return F.coalesce(
        F.nullif(_col(uuid), F.lit("")), F.nullif(_col(other_id), F.lit("")), _col(native_id).cast("string")
    )


def clean_properties(properties: Column | str) -> Column:
    return F.map_filter(_col(properties), lambda key, _: ~key.isin(SKIPPED_PROPERTIES))


def json_safe(value: Column | str, nested: bool) -> Column:
    """Nested values become JSON text, primitives plain text."""
    return F.to_json(_col(value)) if nested else _col(value).cast("string")


def edge_label(rel_type: Column | str) -> Column:
    return F.coalesce(_col(rel_type), F.lit("RELATED_TO"))


def edge_id(source: Column | str, rel_type: Column | str, target: Column | str) -> Column:
    return F.concat_ws("-", _col(source), edge_label(rel_type), _col(target))
