"""One registered query per operator of the inventory, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregraph.functions import defaults, domains, keys, labels, nodes, redact, text
from loregraph.operators import extract, lexical, rank, requests, resolve, rules, scale, view
from loregraph.plans import graph_view, ingest, insights, search
from loregraph.session import new_folder
from loregraph.sources import requests as sources
from loregraph.sources import store as stores_api
from workload import inputs, sql, stores
from workload.inputs import table
from workload.registry import QUERIES, query  # noqa: F401 - re-exported
from workload.stores import fixed_now


def day(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- sources and sinks ---------------------------------------------------------
@query("S1_episode_source", """SELECT 'Lang-' || lang AS client_slug, doc_id::VARCHAR AS source_id,
 CASE WHEN n_chars < 300 THEN 'note' ELSE 'document_analysis' END AS episode_type, md5(text) AS content_md5,
 CASE WHEN lang = 'en' THEN 2 ELSE 0 END::BIGINT AS metadata_keys,
 strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS at FROM documents""")
def _(spark, d):
    path = new_folder(spark, "episodes-json")
    inputs.document_requests(spark, d, short_notes=True).write.json(path)
    got = sources.read_requests(spark, "episode", path)
    return got.select(
        "client_slug", "source_id", "episode_type", F.md5("content").alias("content_md5"),
        F.size("metadata").cast("long").alias("metadata_keys"), day("timestamp").alias("at"),
    )


@query("S2_bootstrap_source", f"""WITH r AS ({sql.BOOTSTRAP_EPISODES}) SELECT g AS group_id, ep AS episode_uuid, seq::BIGINT AS seq,
 doc_pos::BIGINT AS doc_pos, md5(content) AS content_md5 FROM r""")
def _(spark, d):
    path = new_folder(spark, "bootstrap-json")
    inputs.bootstrap_requests(spark, d).write.json(path)
    rows = requests.bootstrap_rows(sources.read_requests(spark, "bootstrap", path), fixed_now())
    return rows.select("group_id", "episode_uuid", "seq", "doc_pos", F.md5("content").alias("content_md5"))


@query("S3_structured_source", f"""{sql.ORDERS} SELECT g AS group_id, ep AS episode_uuid, pos::BIGINT AS pos, nm AS name, ty AS type,
 de AS description FROM ent""")
def _(spark, d):
    path = new_folder(spark, "structured")
    inputs.order_requests(spark, d).write.parquet(path)
    got = sources.read_requests(spark, "structured", path, "parquet")
    _, entities, _ = requests.structured_rows(got, fixed_now())
    return entities.drop("seq")


@query("S4_episode_sink", f"""{sql.ORDERS_FRESH} SELECT g AS group_id, ep AS uuid, name, '' AS content, 'text' AS source,
 'orders' AS source_description, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS valid_at, '2024-06-01 00:00:00' AS created_at,
 seq AS ingest_seq FROM req""")
def _(spark, d):
    rows = stores.order_store(spark, d).table("episodes")
    return rows.select("group_id", "uuid", "name", "content", "source", "source_description",
                       day("valid_at").alias("valid_at"), day("created_at").alias("created_at"), "ingest_seq")


@query("S5_entity_sink", f"{sql.ORDERS_FRESH} {sql.ENTITIES}")
def _(spark, d):
    rows = stores.order_store(spark, d).table("entities")
    return rows.select("group_id", "uuid", "name", "name_lower", "summary", F.col("labels")[0].alias("label"), "first_seq")


@query("S6_mention_sink", sql.ORDER_MENTIONS_FRESH)
def _(spark, d):
    return stores.order_store(spark, d).table("mentions").select("group_id", "episode_uuid", "pos", "entity_uuid")


@query("S7_fact_sink", f"{sql.ORDERS_FRESH} {sql.FACTS}")
def _(spark, d):
    rows = stores.order_store(spark, d).table("facts")
    return rows.select("group_id", "uuid", "source_uuid", "target_uuid", "rel_type", "name", "fact",
                       F.col("episodes")[0].alias("episode"))


@query("S7_resubmitted", f"""SELECT min(c_custkey) AS query_id, {sql.graph('client', 'c_mktsegment')} AS graph_name, 3::BIGINT AS n, 3::BIGINT AS n_distinct
 FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey) GROUP BY c_mktsegment""")
def _(spark, d):
    """All requests sent twice, in two batches: a search still returns as many facts as asked, all different."""
    store = stores_api.GraphStore(spark, new_folder(spark, "twice"))
    sent = stores.staged_requests(spark, d)
    for batch in ("first", "again"):
        stored = store.entities_for(sent.select(keys.client_graph("client_slug").alias("group_id")), batch)
        store.append(ingest.ingest_structured(sent, stored, fixed_now()), batch, fixed_now())
    slugs = sent.select("client_slug").distinct().join(table(spark, d, "customer"), F.col("client_slug") == F.col("c_mktsegment"))
    asked = slugs.groupBy("client_slug").agg(F.min("c_custkey").alias("query_id")).select(
        "query_id", "client_slug", F.lit("e").alias("engagement_id"), F.lit("places precedes").alias("query"), F.lit(3).alias("max_results"),
        F.lit(False).alias("include_segment"), F.lit(None).cast("string").alias("industry"))
    valid, _ = requests.validate(asked, "search")
    hits = search.search_hits(valid, store.table("facts"))      # different facts may read the same, so their ids are counted
    return hits.groupBy("query_id", F.col("group_id").alias("graph_name")).agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("n_distinct"))


@query("S7_resubmitted_ranks", f"""{sql.ORDERS_FRESH}, fct AS (SELECT g, {sql.stable_id("'fact'", 'ep', 'pos')} AS id, fact AS body FROM lnk WHERE src IS NOT NULL AND tgt IS NOT NULL),
 ask AS (SELECT min(c_custkey) AS query_id, {sql.graph('client', 'c_mktsegment')} AS g, 'places precedes' AS body FROM customer GROUP BY c_mktsegment),
 {sql.bm25('SELECT * FROM fct', 'SELECT * FROM ask', 15)}
 SELECT query_id, g AS group_id, id AS uuid, rank::BIGINT AS rank FROM top""")
def _(spark, d):
    """A third of the facts stored twice: they rank as if all had been stored once."""
    facts = stores.order_store(spark, d).table("facts")
    facts = facts.unionByName(facts.filter(F.pmod(F.xxhash64("uuid"), F.lit(3)) == 0))
    asked = table(spark, d, "customer").groupBy(keys.client_graph("c_mktsegment").alias("group_id")).agg(F.min("c_custkey").alias("query_id"))
    asked = asked.select("query_id", F.lit("client").alias("scope"), "group_id", F.lit("places precedes").alias("text"))
    got = search.ranked_facts(asked, facts)
    return got.select("query_id", "group_id", F.col("doc_id").alias("uuid"), F.col("rank").cast("long").alias("rank"))


@query("S8_taxonomy", """SELECT CASE WHEN n_chars < 300 THEN 'note' ELSE 'document_analysis' END AS episode_type,
 n_chars >= 300 AS known, count(*) AS n FROM documents GROUP BY ALL""")
def _(spark, d):
    known = sources.episode_types(spark).withColumn("known", F.lit(True))
    rows = inputs.document_requests(spark, d, short_notes=True).groupBy("episode_type").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(known), "episode_type", "left").select(
        "episode_type", F.coalesce("known", F.lit(False)).alias("known"), "n")


@query("S8_entity_types", "SELECT DISTINCT p_type AS name, p_brand AS description FROM part")
def _(spark, d):
    path = new_folder(spark, "taxonomy")
    table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("description")).distinct().write.json(path)
    return sources.entity_types(spark, path)


_FINDINGS = """SELECT d.doc_id, 'Finding on ' || coalesce(strftime(o_orderdate, '%-m/%-d/%Y'), 'no day') || ' in ' || lang AS title,
 d.text || coalesce(' paid $' || format('{:,.2f}', o_totalprice) || ' on ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' call 555-010-'
 || lpad((d.doc_id % 10000)::VARCHAR, 4, '0'), '') AS content, source AS type FROM documents d LEFT JOIN orders ON doc_id = o_orderkey"""
_DRAFTS = f"""SELECT doc_id, title AS original_title, md5(content) AS original_md5, {sql.redact('title')} AS draft_title,
 md5({sql.redact('content')}) AS draft_md5, type AS finding_type, 'draft' AS status FROM ({_FINDINGS})"""


def _drafts(df):
    return df.select("doc_id", "original_title", F.md5("original_content").alias("original_md5"), "draft_title",
                     F.md5("draft_content").alias("draft_md5"), "finding_type", "status")


@query("S9_drafts_sink", _DRAFTS)
def _(spark, d):
    path = new_folder(spark, "drafts")
    insights.draft_insights(inputs.findings(spark, d)).write.parquet(path)
    return _drafts(spark.read.parquet(path))


_SIZES = f"""{sql.ORDERS_FRESH}, ep AS (SELECT g, count(*) AS n FROM req GROUP BY g), en AS (SELECT g, count(*) FILTER (created) AS n, count(*) AS m FROM res GROUP BY g),
 fa AS (SELECT g, count(*) AS n FROM lnk WHERE src IS NOT NULL AND tgt IS NOT NULL GROUP BY g)"""
_LISTED = """SELECT ep.g AS group_id, CASE WHEN ep.g = 'client_machinery' THEN 0 ELSE ep.n END::BIGINT AS episodes,
 CASE WHEN ep.g = 'client_machinery' THEN 0 ELSE en.n END::BIGINT AS entities, CASE WHEN ep.g = 'client_machinery' THEN 0 ELSE en.m END::BIGINT AS mentions,
 CASE WHEN ep.g = 'client_machinery' THEN 0 ELSE fa.n END::BIGINT AS facts FROM ep JOIN en ON en.g = ep.g JOIN fa ON fa.g = ep.g WHERE ep.g <> 'client_building'"""


@query("S10_init_graph", f"""SELECT {sql.graph('client', 's')} AS group_id, 'client' AS kind, count(*) AS rows_listed
 FROM (SELECT c_mktsegment AS s FROM customer UNION SELECT r_name FROM region) GROUP BY ALL""")
def _(spark, d):
    store = stores_api.GraphStore(spark, new_folder(spark, "init"))
    store.init_graphs(table(spark, d, "customer").select(F.col("c_mktsegment").alias("client_slug")))
    both = table(spark, d, "region").select(F.col("r_name").alias("client_slug")).union(
        table(spark, d, "customer").select("c_mktsegment"))
    store.init_graphs(both)
    return store.list_graphs().groupBy("group_id", "kind").agg(F.count("*").alias("rows_listed"))


@query("S11_reset_graph", f"{_SIZES} SELECT * FROM ({_LISTED}) WHERE group_id = 'client_machinery'")
def _(spark, d):
    return stores.administered_store(spark, d).graph_sizes().filter("group_id = 'client_machinery'")


@query("S12_delete_graph", f"""WITH l AS (SELECT DISTINCT {sql.graph('client', 's')} AS group_id
 FROM (SELECT c_mktsegment AS s FROM customer UNION SELECT r_name FROM region)) SELECT group_id FROM l WHERE group_id <> 'client_building'""")
def _(spark, d):
    return stores.administered_store(spark, d).list_graphs().select("group_id")


@query("S13_list_graphs", f"""{_SIZES} {_LISTED} UNION ALL SELECT {sql.graph('client', 'r_name')}, 0, 0, 0, 0 FROM region""")
def _(spark, d):
    return stores.administered_store(spark, d).graph_sizes()


@query("S14_view_sink", f"""{sql.view(200)} SELECT 'node' AS kind, g AS group_id, id, name, type, 0::BIGINT AS n FROM vn
 UNION ALL SELECT 'edge', g, id, source || '>' || target || ':' || fact, label, 0 FROM vy
 UNION ALL SELECT 'count', coalesce(n.g, e.g), '', 'edges ' || coalesce(e.n, 0), '', coalesce(n.n, 0) FROM
  (SELECT g, count(*) AS n FROM vn GROUP BY g) n FULL JOIN (SELECT g, count(*) AS n FROM vy GROUP BY g) e ON n.g = e.g""")
def _(spark, d):
    path = new_folder(spark, "view")
    got = graph_view.graph_view(inputs.region_nodes(spark, d), inputs.region_edges(spark, d), 200, check_ends=True)
    graph_view.write_view(got, path)
    shown, edges, counts = (spark.read.schema(frame.schema).json(f"{path}/{name}") for name, frame in got._asdict().items())
    blank = F.lit("")
    return shown.select(F.lit("node").alias("kind"), "group_id", "id", "name", "type", F.lit(0).cast("long").alias("n")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "group_id", "id", F.concat("source", F.lit(">"), "target", F.lit(":"), "fact").alias("name"),
                     F.col("label").alias("type"), F.lit(0).cast("long").alias("n"))).unionByName(
        counts.select(F.lit("count").alias("kind"), "group_id", blank.alias("id"), F.concat(F.lit("edges "), F.col("edge_count").cast("string")).alias("name"),
                      blank.alias("type"), F.col("node_count").alias("n")))


@query("S14_stored_nodes", f"""{sql.ORDERS_FRESH}, kept AS (SELECT * FROM res WHERE created QUALIFY row_number() OVER (PARTITION BY g ORDER BY uuid, nm) <= 500)
SELECT g AS group_id, uuid AS id, nm AS name, g AS graph_property, summary, '["' || label || '"]' AS labels, '2024-06-01 00:00:00' AS created_at FROM kept""")
def _(spark, d):
    """Nodes of a stored graph show all that was stored."""
    store = stores.order_store(spark, d)
    got = graph_view.stored_view(store.table("entities"), store.table("facts")).nodes
    props = F.col("properties")
    return got.select("group_id", "id", "name", props["group_id"].alias("graph_property"), props["summary"].alias("summary"), props["labels"].alias("labels"),
                      props["created_at"].alias("created_at"))


# --- projections and filters -----------------------------------------------------
_SLUG = "c_mktsegment || '-' || c_name || ' é.' || c_nationkey"


def _slugs(spark, d):
    slug = F.concat("c_mktsegment", F.lit("-"), "c_name", F.lit(" é."), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", slug.alias("slug"))


@query("P1_client_key", f"SELECT c_custkey, {sql.graph('client', _SLUG)} AS graph_name FROM customer")
def _(spark, d):
    return _slugs(spark, d).select("c_custkey", keys.client_graph("slug").alias("graph_name"))


@query("P2_segment_key", f"SELECT c_custkey, {sql.graph('segment', _SLUG)} AS graph_name FROM customer")
def _(spark, d):
    return _slugs(spark, d).select("c_custkey", keys.segment_graph("slug").alias("graph_name"))


@query("P3_name_normalize", f"SELECT event_id, lower({sql.strip(chr(39) + '  ' + chr(39) + ' || upper(event_type) || ' + chr(39) + ' ' + chr(39) + ' || user_id || chr(10)')}) AS name_key FROM events")
def _(spark, d):
    name = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit("\n"))
    return table(spark, d, "events").select("event_id", keys.normalize_name(name).alias("name_key"))


@query("P4_episode_naming", """SELECT doc_id, CASE WHEN n_chars < 300 THEN 'note' ELSE 'document_analysis' END || ': document/' || doc_id AS name,
 'Engagement ' || source || ' — ' || CASE WHEN n_chars < 300 THEN 'note' ELSE 'document_analysis' END || ' from document' AS description FROM documents""")
def _(spark, d):
    return inputs.document_requests(spark, d, short_notes=True).select(
        F.col("ingest_seq").alias("doc_id"), text.episode_name("episode_type", "source_type", "source_id").alias("name"),
        text.episode_description("engagement_id", "episode_type", "source_type").alias("description"))


@query("P5_metadata_enrichment", f"SELECT seq AS doc_id, md5(content) AS content_md5, length(content) AS n FROM ({sql.DOCUMENT_EPISODES.replace('WHERE n_chars >= 300', '')})")
def _(spark, d):
    content = text.enrich_content("content", "metadata")
    return inputs.document_requests(spark, d).select(
        F.col("ingest_seq").alias("doc_id"), F.md5(content).alias("content_md5"), F.length(content).cast("long").alias("n"))


@query("P6_bootstrap_naming", f"SELECT request_seq, doc_pos::BIGINT AS doc_pos, document, name, description, valid FROM ({sql.BOOTSTRAP_EPISODES})")
def _(spark, d):
    return requests.bootstrap_rows(inputs.bootstrap_requests(spark, d), fixed_now()).select(
        "request_seq", "doc_pos", "document", "name", F.col("source_description").alias("description"), day("valid_at").alias("valid"))


@query("P7_insight_naming", f"SELECT n_nationkey, 'segment_insight: ' || r_name AS name, {sql.graph('segment', 'r_name')} AS group_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", text.insight_name("r_name").alias("name"), keys.segment_graph("r_name").alias("group_id"))


@query("P8_validation", """SELECT 'episode' AS kind, doc_id AS id, CASE WHEN n_chars < 300 THEN 'unknown episode_type' ELSE '' END AS reason FROM documents
 UNION ALL SELECT 'search', item_id, CASE WHEN length(text) % 53 BETWEEN 1 AND 50 THEN '' ELSE 'max_results not in 1..50' END FROM benchmark
 UNION ALL SELECT 'bootstrap', doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing engagement_id' WHEN doc_id % 3 = 0 THEN 'missing documents'
  WHEN doc_id % 2 = 0 THEN 'missing ingest_seq' ELSE '' END FROM documents
 UNION ALL SELECT 'structured', o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'missing client_slug' WHEN o_orderkey % 11 = 0 THEN 'missing episode_name'
  WHEN o_orderkey % 7 = 0 THEN 'missing ingest_seq' WHEN o_orderkey % 5 = 0 THEN 'missing entities.name' WHEN o_orderkey % 3 = 0 THEN 'missing entities.type'
  WHEN o_orderkey % 2 = 0 THEN 'missing relationships.target' ELSE '' END FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    def unless(column, divisor, key):
        return F.when(F.col(key) % divisor != 0, F.col(column))

    def member(array, field, divisor):
        return F.transform(array, lambda x: x.withField(field, F.when(F.col("id") % divisor != 0, x[field])))

    boot = inputs.bootstrap_requests(spark, d).withColumn("id", F.col("ingest_seq")).withColumns({
        "engagement_id": unless("engagement_id", 5, "id"), "documents": unless("documents", 3, "id"), "ingest_seq": unless("ingest_seq", 2, "id")})
    orders = inputs.order_requests(spark, d).withColumn("id", F.col("ingest_seq")).withColumns({
        "client_slug": unless("client_slug", 13, "id"), "episode_name": unless("episode_name", 11, "id"), "ingest_seq": unless("ingest_seq", 7, "id"),
        "entities": member("entities", "name", 5)}).withColumns({
        "entities": member("entities", "type", 3), "relationships": member("relationships", "target", 2)})

    def both(df, kind, key):
        good, bad = requests.validate(df, kind)
        head = [F.lit(kind).alias("kind"), F.col(key).alias("id")]
        return good.select(*head, F.lit("").alias("reason")).union(bad.select(*head, "reason"))

    return both(inputs.document_requests(spark, d, short_notes=True), "episode", "ingest_seq").union(
        both(inputs.search_requests(spark, d), "search", "query_id")).union(both(boot, "bootstrap", "id")).union(both(orders, "structured", "id"))


_NODES = f"WITH {sql.REGION_GRAPH} "


@query("P9_non_episodic", f"{_NODES} SELECT g AS group_id, native AS native_id FROM nodes WHERE NOT epi")
def _(spark, d):
    return view.not_episodic(inputs.region_nodes(spark, d)).select("group_id", "native_id")


@query("P10_node_identity", f"{_NODES} SELECT g AS group_id, native AS native_id, id, name FROM nodes")
def _(spark, d):
    return inputs.region_nodes(spark, d).select(
        "group_id", "native_id", nodes.node_id("properties", "native_id").alias("id"),
        nodes.node_name("properties", "native_id").alias("name"))


@query("P11_endpoint_identity", f"{_NODES} SELECT g AS group_id, eid AS edge_uuid, source, target FROM edges")
def _(spark, d):
    return view.edge_ends(inputs.region_edges(spark, d)).select("group_id", "edge_uuid", "source", "target")


@query("P12_base_type", f"{_NODES} SELECT g AS group_id, native AS native_id, base AS base_type FROM nod")
def _(spark, d):
    return inputs.region_nodes(spark, d).select("group_id", "native_id", labels.base_type("node_labels").alias("base_type"))


@query("P13_domain_label", """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN c_mktsegment WHEN c_nationkey % 4 = 1 THEN '' ELSE c_mktsegment END AS label FROM customer""")
def _(spark, d):
    quarter = F.col("c_nationkey") % 4
    as_list = F.when(quarter == 3, F.array("c_mktsegment", F.lit("x")))
    as_text = (
        F.when(quarter == 0, F.concat(F.lit(" ['"), "c_mktsegment", F.lit("', 'Unit'] ")))
        .when(quarter == 1, F.lit("[]")).when(quarter == 2, F.concat(F.lit("  "), "c_mktsegment", F.lit("\n")))
    )
    return table(spark, d, "customer").select("c_custkey", labels.domain_label(as_list, as_text).alias("label"))


# The labels of the map and the types it gives; the last label is not in it.
_KINDS = ["Stakeholder", "Consultant", "Person", "Department", "Role", "Process", "System", "Finding", "PainPoint", "Pain_Point", "Opportunity", "Goal",
          "Regulation", "Policy", "Decision", "Risk", "Metric", "Deliverable", "Document", "Location", "Gadget"]
_TYPES = ["person", "person", "person", "department", "role", "process", "system", "theme", "pain_point", "pain_point", "opportunity", "opportunity",
          "regulation", "policy", "process", "pain_point", "metric", "entity", "entity", "entity", ""]


@query("P14_visual_type", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({_TYPES})[l_partkey % 21 + 1] AS type FROM lineitem")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 21 + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(labels.visual_type(kind), F.lit("")).alias("type"))


@query("P15_heuristic", """SELECT event_id, CASE event_type WHEN 'error' THEN 'pain_point' ELSE 'entity' END AS type FROM events""")
def _(spark, d):
    name = F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"))
    summary = F.concat("event_type", F.lit(" "), "props")
    keyed = labels.with_rule_keys(table(spark, d, "events"), name, summary)
    return keyed.select("event_id", labels.heuristic_type("name_key", "summary_key").alias("type"))


# A name or summary for every rule, and for pairs of rules of which the first must win.
_RULE_NAMES = ["part", "Internal Audit", "The Gaming Commission office", " TLS ", "AC-2 access", "Title 31", "FIPS 140-2", "Visitor Policy", "AC-1 Policy",
               "internal audit policy"]
_RULE_SUMMARIES = ["", "a broken process", "coverage gap in software", "an opportunity for the platform", "Software process", "workflow of a department",
                   "division under a statute", "statute and directive", "an internal rule", "nothing of the kind"]


@query("P15_rule_order", """SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'department' WHEN 2 THEN 'department' WHEN 3 THEN 'system' WHEN 4 THEN 'regulation'
 WHEN 5 THEN 'regulation' WHEN 6 THEN 'regulation' WHEN 7 THEN 'policy' WHEN 8 THEN 'regulation' WHEN 9 THEN 'department' ELSE
 CASE p_partkey // 10 % 10 WHEN 1 THEN 'pain_point' WHEN 2 THEN 'pain_point' WHEN 3 THEN 'opportunity' WHEN 4 THEN 'system' WHEN 5 THEN 'process'
 WHEN 6 THEN 'department' WHEN 7 THEN 'regulation' WHEN 8 THEN 'policy' ELSE 'entity' END END AS type FROM part""")
def _(spark, d):
    def pick(values, at):
        return F.get(F.array(*map(F.lit, values)), at.cast("int"))

    number = F.col("p_partkey")
    keyed = labels.with_rule_keys(table(spark, d, "part"), pick(_RULE_NAMES, number % 10), pick(_RULE_SUMMARIES, F.floor(number / 10) % 10))
    return keyed.select("p_partkey", labels.heuristic_type("name_key", "summary_key").alias("type"))


@query("P15_tenant_rules", f"""WITH r AS (SELECT ['en', 'de', 'fr', 'es'][item_id % 5] AS rule_set, item_id AS priority, item_id % 3 AS op, 't' || item_id AS result,
  lower(CASE item_id % 3 WHEN 0 THEN substr(text, 5, 3 + item_id % 9) WHEN 1 THEN substr(text, 1, 2) ELSE split_part(text, ' ', 1) END) AS term FROM benchmark),
 d AS (SELECT doc_id, lang, {sql.strip("lower(split_part(text, ' ', 1))")} AS n, lower(text) AS s FROM documents)
SELECT doc_id, coalesce(min_by(result, priority), 'entity') AS type FROM d LEFT JOIN r ON term <> '' AND (rule_set IS NULL OR rule_set = lang)
 AND CASE op WHEN 0 THEN contains(s, term) WHEN 1 THEN starts_with(n, term) ELSE n = term END GROUP BY doc_id""")
def _(spark, d):
    """Documents typed by rules out of benchmark items, most of them for one language alone."""
    number = F.col("item_id")

    def one_of(*values):
        return F.get(F.array(*values), (number % 3).cast("int"))

    given = table(spark, d, "benchmark").select(
        F.get(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (number % 5 - 1).cast("int")).alias("rule_set"), number.cast("int").alias("priority"),
        one_of(F.lit("summary"), F.lit("name"), F.lit("name")).alias("field"), one_of(F.lit("contains"), F.lit("startswith"), F.lit("equals")).alias("op"),
        one_of(F.substring("text", F.lit(5), (3 + number % 9).cast("int")), F.substring("text", 1, 2), F.split_part("text", F.lit(" "), F.lit(1))).alias("term"),
        F.concat(F.lit("t"), number.cast("string")).alias("result"))
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("group_id"), "text")
    keyed = labels.with_rule_keys(docs, F.split_part("text", F.lit(" "), F.lit(1)), F.col("text"))
    return rules.rule_types(keyed, given).select("doc_id", "type")


@query("P16_property_cleaning", """SELECT event_id, event_type || '|' || props AS kept FROM events""")
def _(spark, d):
    props = F.create_map(F.lit("uuid"), F.lit("u"), F.lit("summary"), "event_type", F.lit("content"), "props",
                         F.lit("raw"), "props", F.lit("source"), F.lit("s"))
    kept = F.array_join(F.map_values(nodes.clean_properties(props)), "|")
    return table(spark, d, "events").select("event_id", kept.alias("kept"))


@query("P17_edge_id", f"{_NODES} SELECT g AS group_id, eid AS edge_uuid, id, label FROM edges")
def _(spark, d):
    return view.edge_ends(inputs.region_edges(spark, d)).select("group_id", "edge_uuid", "id", "label")


@query("P18_fact_projection", f"""WITH {sql.CONVERSATION_FACTS} SELECT g AS group_id, id AS uuid, subject, predicate, object, md5(body) AS fact_md5,
 NULL::VARCHAR AS valid_from FROM facts""")
def _(spark, d):
    got = search.fact_result(inputs.conversation_facts(spark, d))
    return got.select("group_id", "uuid", "subject", "predicate", "object", F.md5("fact").alias("fact_md5"), day("valid_from").alias("valid_from"))


@query("P18_fact_validity", """SELECT o_orderkey::VARCHAR AS uuid, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS valid_from,
 CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') END AS valid_to,
 CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate + INTERVAL 60 DAY, '%Y-%m-%d %H:%M:%S') END AS expired_at FROM orders""")
def _(spark, d):
    """Facts that have begun, ended and expired; expired ones stay in."""
    at, number = F.col("o_orderdate"), F.col("o_orderkey")
    facts = table(spark, d, "orders").select(
        F.lit("g").alias("group_id"), number.cast("string").alias("uuid"), F.lit("s").alias("source_uuid"), F.lit("p").alias("name"),
        F.lit("t").alias("target_uuid"), F.lit("f").alias("fact"), at.alias("valid_at"),
        F.when(number % 3 == 0, at + F.expr("INTERVAL 30 DAYS")).alias("invalid_at"), F.when(number % 5 == 0, at + F.expr("INTERVAL 60 DAYS")).alias("expired_at"))
    return search.fact_result(facts).select("uuid", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), day("expired_at").alias("expired_at"))


@query("P19_insight_filter", f"""{sql.SEARCH} SELECT query_id, rank::BIGINT AS rank, md5(fact) AS fact_md5 FROM hits WHERE scope = 'segment' AND fact <> ''""")
def _(spark, d):
    valid, _ = requests.validate(inputs.search_requests(spark, d), "search")
    hits = search.search_hits(valid, inputs.conversation_facts(spark, d))
    return hits.filter("scope = 'segment' AND fact IS NOT NULL AND fact <> ''").select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.md5("fact").alias("fact_md5"))


@query("P20_entity_defaults", f"""{sql.ORDERS} SELECT ep AS episode_uuid, pos::BIGINT AS pos, CASE WHEN ty = '' THEN 'Entity' ELSE {sql.strip('ty')} END AS label,
 {sql.strip('de')} AS summary FROM ent""")
def _(spark, d):
    _, entities, _ = requests.structured_rows(inputs.order_requests(spark, d), fixed_now())
    return entities.select("episode_uuid", "pos", defaults.entity_label("type").alias("label"),
                           defaults.entity_summary("description").alias("summary"))


@query("P21_relationship_defaults", f"{sql.ORDERS} SELECT ep AS episode_uuid, pos::BIGINT AS pos, name, fact FROM lnk")
def _(spark, d):
    _, _, relationships = requests.structured_rows(inputs.order_requests(spark, d), fixed_now())
    return requests.relations(relationships).select("episode_uuid", "pos", "name", "fact")


@query("P22_blank_names", f"{sql.ORDERS} SELECT ep AS episode_uuid, pos::BIGINT AS pos, nm AS name, k AS name_lower FROM occ")
def _(spark, d):
    _, entities, _ = requests.structured_rows(inputs.order_requests(spark, d), fixed_now())
    return requests.occurrences(entities).select("episode_uuid", "pos", "name", "name_lower")


@query("P23_destructive_guard", """SELECT c_custkey, c_mktsegment = 'MACHINERY' AS accepted FROM customer""")
def _(spark, d):
    sentence = domains.CONFIRM_SENTENCE
    asked = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(sentence))
        .when(F.col("c_mktsegment") == "BUILDING", F.lit(sentence.lower()))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(sentence + " ")).alias("confirm"))
    good, bad = stores_api.confirm(asked)
    return good.select("c_custkey", F.lit(True).alias("accepted")).union(bad.select("c_custkey", F.lit(False)))


@query("P24_edge_fact", f"{_NODES} SELECT g AS group_id, eid AS edge_uuid, fact FROM edges")
def _(spark, d):
    return view.edge_ends(inputs.region_edges(spark, d)).select("group_id", "edge_uuid", "fact")


# --- joins -------------------------------------------------------------------------
def _orders(spark, d):
    return ingest.ingest_structured(
        inputs.order_requests(spark, d), inputs.stored_customers(spark, d), fixed_now())


def _order_parts(spark, d):
    _, entities, relationships = requests.structured_rows(inputs.order_requests(spark, d), fixed_now())
    return requests.occurrences(entities), requests.relations(relationships)


@query("J1_entity_resolution", f"{sql.ORDERS} {sql.ENTITIES}")
def _(spark, d):
    return _orders(spark, d).entities.withColumn("label", F.col("labels")[0]).drop("labels")


@query("J2_mentions", sql.ORDER_MENTIONS)
def _(spark, d):
    return _orders(spark, d).mentions


@query("J3_relationship_endpoints", f"{sql.ORDERS} {sql.FACTS}")
def _(spark, d):
    return _orders(spark, d).facts.withColumn("episode", F.col("episodes")[0]).select(
        "group_id", "uuid", "source_uuid", "target_uuid", "rel_type", "name", "fact", "episode")


@query("J4_skipped_relationships", f"""{sql.ORDERS} SELECT g AS group_id, ep AS episode_uuid, pos::BIGINT AS pos,
 src IS NULL AS no_source, tgt IS NULL AS no_target FROM lnk WHERE src IS NULL OR tgt IS NULL""")
def _(spark, d):
    return _orders(spark, d).skipped.select(
        "group_id", "episode_uuid", "pos", F.isnull("source_uuid").alias("no_source"), F.isnull("target_uuid").alias("no_target"))


@query("J5_ends_in_view", f"""{sql.view(200)} SELECT e.g AS group_id, eid AS edge_uuid FROM edges e
 WHERE EXISTS (SELECT 1 FROM vn WHERE vn.g = e.g AND vn.id = e.source) AND EXISTS (SELECT 1 FROM vn WHERE vn.g = e.g AND vn.id = e.target)""")
def _(spark, d):
    picked = view.limited_nodes(inputs.region_nodes(spark, d), 200)
    return view.within(view.edge_ends(inputs.region_edges(spark, d)), picked.select("group_id", F.col("id").alias("node"))).select("group_id", "edge_uuid")


@query("J6_edge_pattern", f"""{_NODES} SELECT e.g AS group_id, eid AS edge_uuid FROM edges e
 WHERE EXISTS (SELECT 1 FROM nodes n WHERE NOT epi AND n.g = e.g AND n.id = e.source) AND EXISTS (SELECT 1 FROM nodes n WHERE NOT epi AND n.g = e.g AND n.id = e.target)""")
def _(spark, d):
    return view.edge_pattern(view.edge_ends(inputs.region_edges(spark, d)), inputs.region_nodes(spark, d)).select("group_id", "edge_uuid")


@query("J7_tenant_scope", f"""{sql.ORDERS_FRESH} SELECT g AS group_id, count(*) AS n FROM res WHERE created
 AND g IN (SELECT {sql.graph('client', 'c_mktsegment')} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_mktsegment LIKE '%U%') GROUP BY g""")
def _(spark, d):
    asked = inputs.order_requests(spark, d).filter("client_slug LIKE '%U%' AND entities[2].name = 'Status O'")
    groups = asked.select(keys.client_graph("client_slug").alias("group_id"))
    return stores.order_store(spark, d).entities_for(groups).groupBy("group_id").agg(F.count("*").alias("n"))


_Q1_DOCS = "SELECT lang AS g, doc_id AS id, text AS body FROM documents"
_Q1_QUERIES = "SELECT item_id AS query_id, lang AS g, text AS body FROM benchmark, (SELECT DISTINCT lang FROM documents)"


def _language_docs(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("group_id"), "doc_id", "text")


def _language_queries(spark, d):
    languages = sorted(r.lang for r in table(spark, d, "documents").select("lang").distinct().collect() if r.lang is not None)
    every = F.explode(F.array(*map(F.lit, languages))).alias("group_id")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), every, "text")


@query("J8_term_match", f"""WITH {sql.bm25(_Q1_DOCS, _Q1_QUERIES, 10)} SELECT g AS group_id, id AS doc_id, dl::BIGINT AS dl, term, tf FROM tf""")
def _(spark, d):
    found = lexical.postings(_language_docs(spark, d), lexical.query_terms(_language_queries(spark, d))).filter(~lexical.is_mark())
    return found.select("group_id", "doc_id", F.col("dl").cast("long").alias("dl"), "term", "tf")


_DOCS = f"WITH {sql.extraction(sql.DOCUMENT_EPISODES)}"
_BOOT = f"WITH {sql.extraction(sql.BOOTSTRAP_EPISODES)}"
_PROMOTED = f"WITH {sql.extraction(sql.PROMOTED_EPISODES)}"


def _episode_rows(spark, d):
    valid, _ = requests.validate(inputs.document_requests(spark, d), "episode")
    return requests.episode_rows(valid, fixed_now())


@query("J9_gazetteer_match", f"""{_DOCS} SELECT g AS group_id, ep AS episode_uuid, sent::BIGINT AS sent, gram, name, place::BIGINT AS place FROM seen""")
def _(spark, d):
    names = extract.gazetteer(inputs.benchmark_terms(spark, d))
    return extract.sightings(_episode_rows(spark, d), names).select(
        "group_id", "episode_uuid", F.col("sent").cast("long").alias("sent"), "gram", "name", "place")


# --- aggregations --------------------------------------------------------------------
@query("A1_ingest_counters", f"{sql.ORDERS} {sql.COUNTERS}")
def _(spark, d):
    return _orders(spark, d).counters


@query("A2_extraction_counts", f"{_DOCS} {sql.EXTRACTION_COUNTS}")
def _(spark, d):
    return ingest.extraction_counts(ingest.ingest_text(_episode_rows(spark, d), inputs.benchmark_terms(spark, d)))


def _region_view(spark, d):
    return graph_view.graph_view(inputs.region_nodes(spark, d), inputs.region_edges(spark, d), 200, check_ends=True)


@query("A3_view_counts", f"""{sql.view(200)} SELECT g AS group_id, count(*) FILTER (n) AS node_count, count(*) FILTER (NOT n) AS edge_count
 FROM (SELECT g, true AS n FROM vn UNION ALL SELECT g, false FROM vy) GROUP BY g""")
def _(spark, d):
    return _region_view(spark, d).counts


@query("A4_graph_count", "SELECT count(DISTINCT c_mktsegment) AS graph_count FROM customer JOIN orders ON o_custkey = c_custkey")
def _(spark, d):
    return stores.order_store(spark, d).list_graphs().agg(F.count("*").alias("graph_count"))


@query("A5_documents_processed", f"""WITH r AS ({sql.BOOTSTRAP_EPISODES}) SELECT g AS group_id, request_seq, count(*) AS documents_processed,
 string_agg(coalesce(document, '-') || '=' || ep, ',' ORDER BY doc_pos) AS results FROM r GROUP BY ALL""")
def _(spark, d):
    report = ingest.bootstrap_report(requests.bootstrap_rows(inputs.bootstrap_requests(spark, d), fixed_now()))
    listed = F.transform("results", lambda x: F.concat(F.coalesce(x["document"], F.lit("-")), F.lit("="), x["episode_id"]))
    return report.select("group_id", "request_seq", "documents_processed", F.array_join(listed, ",").alias("results"))


@query("A6_node_dedupe", """SELECT 'g' AS group_id, p_name AS id, min(p_partkey) AS place FROM part GROUP BY p_name""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.lit("g").alias("group_id"), F.col("p_name").alias("id"), F.col("p_partkey").alias("place"), "p_type")
    return view.dedupe_nodes(rows, ["place"]).select("group_id", "id", "place")


@query("A7_edge_dedupe", f"{_NODES} SELECT g AS group_id, id, source, target, label, fact, eid AS edge_uuid FROM edges QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY eid) = 1")
def _(spark, d):
    return view.dedupe_edges(view.edge_ends(inputs.region_edges(spark, d))).drop("created_at")


@query("A8_collected_answers", f"""{sql.SEARCH} SELECT a.query_id, a.g AS graph_name,
 coalesce(string_agg(md5(fact), ',' ORDER BY rank) FILTER (scope = 'client'), '') AS facts,
 coalesce(string_agg(md5(fact), ',' ORDER BY rank) FILTER (scope = 'segment'), '') AS insights FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id GROUP BY ALL""")
def _(spark, d):
    got = search.search_context(inputs.search_requests(spark, d), inputs.conversation_facts(spark, d))
    return got.select("query_id", "graph_name", F.array_join(F.transform("facts", lambda x: F.md5(x["fact"])), ",").alias("facts"),
                      F.array_join(F.transform("segment_insights", F.md5), ",").alias("insights"))


# --- first-wins and ranks ---------------------------------------------------------------
@query("W1_first_occurrence", f"""{sql.LINES} SELECT g AS group_id, k AS name_lower, seq AS first_seq FROM occ WHERE rn = 1""")
def _(spark, d):
    _, entities, _ = inputs.line_rows(spark, d, staged=False)
    return resolve.first_places(requests.occurrences(entities)).select("group_id", "name_lower", "first_seq")


@query("W2_first_row_per_key", """SELECT c_mktsegment, c_nationkey, c_custkey, c_name FROM customer
 QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal, c_custkey) = 1""")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal", "c_custkey", "c_name")
    return scale.first_wins(rows, ["c_mktsegment", "c_nationkey"], ["c_acctbal", "c_custkey"]).drop("c_acctbal")


@query("W3_rank_per_group", """SELECT c_mktsegment, o_orderkey, rank::BIGINT AS rank FROM (SELECT c_mktsegment, o_orderkey,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 100""")
def _(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    picked = rows.select("c_mktsegment", "o_orderkey", "o_totalprice")
    top = scale.top_n(picked, ["c_mktsegment"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, "rank")
    return top.select("c_mktsegment", "o_orderkey", F.col("rank").cast("long").alias("rank"))


# --- limits and set operations -------------------------------------------------------------
@query("L1_node_limit", f"{sql.view(500)} SELECT g AS group_id, id, name, type FROM vn")
def _(spark, d):
    return view.limited_nodes(inputs.region_nodes(spark, d)).drop("properties")


@query("L2_edge_limit", f"{sql.view(200)} SELECT g AS group_id, eid AS edge_uuid FROM vf")
def _(spark, d):
    edges = view.edge_pattern(view.edge_ends(inputs.region_edges(spark, d)), inputs.region_nodes(spark, d))
    return view.limited_edges(edges, 200).select("group_id", "edge_uuid")


def _hits(scope):
    def run(spark, d):
        valid, _ = requests.validate(inputs.search_requests(spark, d), "search")
        hits = search.search_hits(valid, inputs.conversation_facts(spark, d)).filter(F.col("scope") == scope)
        return hits.select("query_id", "group_id", "uuid", F.col("rank").cast("long").alias("rank"))

    return run


_HITS = f"{sql.SEARCH} SELECT query_id, g AS group_id, id AS uuid, rank::BIGINT AS rank FROM hits WHERE scope = "
query("L3_client_top_k", f"{_HITS} 'client'")(_hits("client"))
query("L5_segment_top_5", f"{_HITS} 'segment'")(_hits("segment"))


@query("L4_response_cut", f"""{sql.SEARCH} SELECT a.query_id, count(h.id) FILTER (scope = 'client') AS facts, count(h.id) FILTER (scope = 'segment') AS insights
 FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id GROUP BY ALL""")
def _(spark, d):
    got = search.search_context(inputs.search_requests(spark, d), inputs.conversation_facts(spark, d))
    return got.select("query_id", F.size("facts").cast("long").alias("facts"), F.size("segment_insights").cast("long").alias("insights"))


@query("L6_single_lookup", f"{sql.ORDERS} SELECT g AS group_id, k AS name_lower, uuid AS stored_uuid FROM st WHERE (g, k) IN (SELECT g, k FROM occ UNION SELECT g, lower(sn) FROM rel)")
def _(spark, d):
    occurrences, relations = _order_parts(spark, d)
    return resolve.stored_names(inputs.stored_customers(spark, d), resolve.asked_names(occurrences, relations))


@query("U1_local_and_stored_names", f"""{sql.ORDERS} SELECT g AS group_id, k AS name_lower, uuid AS entity_uuid, is_stored FROM names
 WHERE (g, k) IN (SELECT g, k FROM occ UNION SELECT g, lower(sn) FROM rel)""")
def _(spark, d):
    occurrences, relations = _order_parts(spark, d)
    return resolve.dictionary(occurrences, relations, inputs.stored_customers(spark, d)).select(
        "group_id", "name_lower", "entity_uuid", "is_stored")


@query("U2_membership", f"{_NODES} SELECT g AS group_id, eid AS edge_uuid FROM edges WHERE source IN (SELECT id FROM nodes WHERE type = 'pain_point')")
def _(spark, d):
    bad = view.typed_nodes(inputs.region_nodes(spark, d)).filter("type = 'pain_point'").select("group_id", F.col("id").alias("source"))
    edges = view.edge_ends(inputs.region_edges(spark, d))
    return edges.join(bad, ["group_id", "source"], "left_semi").select("group_id", "edge_uuid")


@query("U3_facts_beside_insights", f"""{sql.SEARCH} SELECT a.query_id, coalesce(max(id) FILTER (scope = 'client' AND rank = 1), '') AS best_fact,
 coalesce(max(id) FILTER (scope = 'segment' AND rank = 1), '') AS best_insight FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id GROUP BY ALL""")
def _(spark, d):
    valid, _ = requests.validate(inputs.search_requests(spark, d), "search")
    hits = search.search_hits(valid, inputs.conversation_facts(spark, d)).filter("rank = 1")
    best = hits.groupBy("query_id").agg(F.max(F.when(F.col("scope") == "client", F.col("uuid"))).alias("f"),
                                        F.max(F.when(F.col("scope") == "segment", F.col("uuid"))).alias("i"))
    return valid.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce("f", F.lit("")).alias("best_fact"), F.coalesce("i", F.lit("")).alias("best_insight"))


# --- scalar functions -------------------------------------------------------------------------
def _finding_text(spark, d):
    return inputs.findings(spark, d).select("doc_id", "content", "client_name", "known_names")


def _redacted(column):
    def run(spark, d):
        return scale.spread(_finding_text(spark, d), "doc_id").select("doc_id", F.md5(column()).alias("content_md5"))

    return run


def _one(pattern, by, flags="g"):
    return f"SELECT doc_id, md5({sql.replace('content', pattern, by, flags)}) AS content_md5 FROM ({_FINDINGS})"


query("F1a_client_name", _one("tion", "the gaming commission", "gi"))(_redacted(lambda: redact.redact_client("content", "client_name")))
query("F1b_known_names", f"SELECT doc_id, md5({sql.replace(sql.replace('content', 'the on', '[stakeholder]', 'gi'), 'lich', '[stakeholder]', 'gi')}) AS content_md5 FROM ({_FINDINGS})")(
    _redacted(lambda: redact.redact_names("content", "known_names")))
query("F1c_email", _one(sql.EMAIL, "[email]"))(_redacted(lambda: redact.redact_pattern("content", "email")))
query("F1d_phone", _one(sql.PHONE, "[phone]"))(_redacted(lambda: redact.redact_pattern("content", "phone")))
query("F1e_amount", _one(sql.AMOUNT, "[amount]"))(_redacted(lambda: redact.redact_pattern("content", "amount")))
query("F1f_date", _one(sql.DATE, "[date]"))(_redacted(lambda: redact.redact_pattern("content", "date")))


@query("F2_drafts", _DRAFTS)
def _(spark, d):
    return _drafts(insights.draft_insights(inputs.findings(spark, d)))


@query("F3_string_functions", f"""SELECT p_partkey, lower({sql.strip("' ' || upper(p_name) || chr(10)")}) AS cleaned, starts_with(p_name, 'small') AS starts,
 contains(p_name, 'ring') AS has, split_part(p_name, ' ', 1) AS head, replace(p_name, ' ', '_') AS joined FROM part""")
def _(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", keys.normalize_name(F.concat(F.lit(" "), F.upper(name), F.lit("\n"))).alias("cleaned"),
        name.startswith("small").alias("starts"), name.contains("ring").alias("has"),
        F.split_part(name, F.lit(" "), F.lit(1)).alias("head"), F.replace(name, F.lit(" "), F.lit("_")).alias("joined"))


@query("F4_formatting", "SELECT o_orderkey, 'order: ' || o_orderkey || ' — ' || o_orderstatus AS label FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("order: %d — %s", "o_orderkey", "o_orderstatus").alias("label"))


@query("F5_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE ts END, TIMESTAMP '2024-06-01'), '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    given = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format(F.coalesce(given, fixed_now()), "yyyy-MM-dd").alias("day"))


@query("F6_stable_ids", f"SELECT event_id, {sql.stable_id(chr(39) + 'entity' + chr(39), 'event_type', 'user_id')} AS id FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", keys.entity_id("event_type", "user_id").alias("id"))


@query("F7_arrays", "SELECT vec_id, embedding[1]::DOUBLE AS head, len(embedding)::BIGINT AS n, list_contains([label, 3], 3) AS has FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", F.try_element_at("embedding", F.lit(1)).cast("double").alias("head"), F.size("embedding").cast("long").alias("n"),
        F.array_contains(F.array("label", F.lit(3)), F.lit(3)).alias("has"))


@query("F8_maps", """SELECT doc_id, lang AS found, 'none' AS missing, lang || ',' || source AS vals FROM documents""")
def _(spark, d):
    m = F.create_map(F.lit("lang"), "lang", F.lit("id"), F.col("doc_id").cast("string"), F.lit("source"), "source")
    kept = F.map_filter(m, lambda k, v: k != "id")
    return table(spark, d, "documents").select(
        "doc_id", m["lang"].alias("found"), F.coalesce(m["absent"], F.lit("none")).alias("missing"),
        F.array_join(F.transform(F.map_entries(kept), lambda e: e["value"]), ",").alias("vals"))


@query("F9_json_safe", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey::VARCHAR AS plain, '["' || l_returnflag || '","' || l_linestatus || '"]' AS nested FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nodes.json_safe("l_partkey", nested=False).alias("plain"),
        nodes.json_safe(F.array("l_returnflag", "l_linestatus"), nested=True).alias("nested"))


def _e6(column):
    """A score as a whole number of millionths, which both engines state exactly."""
    return F.round(F.col(column) * 1_000_000).cast("long").alias("score_e6")


# --- retrieval and extraction ---------------------------------------------------------------------
@query("Q1_lexical_top_k", f"WITH {sql.bm25(_Q1_DOCS, _Q1_QUERIES, 10)} SELECT query_id, g AS group_id, id AS doc_id, round(score * 1000000)::BIGINT AS score_e6, rank::BIGINT AS rank FROM top")
def _(spark, d):
    got = rank.bm25(_language_docs(spark, d), _language_queries(spark, d), 10)
    return got.select("query_id", "group_id", "doc_id", _e6("score"), F.col("rank").cast("long").alias("rank"))


def _cosine(groups: str, kept: int) -> str:
    """CTEs vec and vtop: the nearest vectors of the same group for the vectors with a benchmark item's number."""
    return f"""grp AS ({groups}),
vec AS (SELECT q.vec_id AS query_id, gq.g, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q JOIN grp gq ON gq.id = q.vec_id JOIN grp ge ON ge.g = gq.g JOIN embeddings e ON e.vec_id = ge.id
 WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= {kept})"""


@query("Q2_vector_top_k", f"WITH {_cosine('SELECT vec_id AS id, label::BIGINT AS g FROM embeddings', 5)} SELECT query_id, g AS group_id, id AS doc_id, round(score * 1000000)::BIGINT AS score_e6, rank::BIGINT AS rank FROM vtop")
def _(spark, d):
    vectors = inputs.labelled_vectors(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    asked = vectors.join(items, "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    got = rank.cosine(vectors, asked, 5)
    return got.select("query_id", "group_id", "doc_id", _e6("score"), F.col("rank").cast("long").alias("rank"))


_FUSE_DOCS = "SELECT lang AS g, doc_id AS id, text AS body FROM documents"
_FUSE_QUERIES = "SELECT item_id AS query_id, lang AS g, b.text AS body FROM benchmark b JOIN documents ON item_id = doc_id"


@query("Q3_fusion", f"""WITH {sql.bm25(_FUSE_DOCS, _FUSE_QUERIES, sql.WHOLE)}, {_cosine('SELECT doc_id AS id, lang AS g FROM documents', sql.WHOLE)},
both_lists AS (SELECT query_id, g, id, rank FROM top UNION ALL SELECT query_id, g, id, rank FROM vtop),
fused AS (SELECT query_id, g, id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM both_lists GROUP BY ALL)
SELECT query_id, g AS group_id, id AS doc_id, round(score * 1000000)::BIGINT AS score_e6, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, id)::BIGINT AS rank FROM fused
QUALIFY row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, id) <= 10""")
def _(spark, d):
    """Whole lists are fused; documents without a vector are found by their text alone."""
    docs = _language_docs(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id", "group_id"), "doc_id")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    asked = items.join(docs.select("doc_id", "group_id"), "doc_id").withColumnRenamed("doc_id", "query_id")
    asked_vectors = vectors.join(items.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    got = rank.fuse_whole(docs, asked, vectors, asked_vectors, 10)
    return got.select("query_id", "group_id", "doc_id", _e6("score"), F.col("rank").cast("long").alias("rank"))


@query("Q4_search_context", f"""{sql.SEARCH} SELECT query_id, rank::BIGINT AS rank, subject, predicate, object, md5(fact) AS fact_md5 FROM hits WHERE scope = 'client'""")
def _(spark, d):
    got = search.search_context(inputs.search_requests(spark, d), inputs.conversation_facts(spark, d))
    each = got.select("query_id", F.posexplode("facts").alias("rank", "f"))
    return each.select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), "f.subject", "f.predicate", "f.object", F.md5("f.fact").alias("fact_md5"))


@query("Q4_hybrid_context", f"""WITH {sql.CONVERSATION_FACTS},
{sql.SEARCH_REQUESTS},
{sql.bm25('SELECT g, id, body FROM facts', 'SELECT query_id, g, body FROM scoped', sql.WHOLE)},
vec AS (SELECT s.query_id, s.g, 'doc-' || lpad(e.vec_id::VARCHAR, 9, '0') AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
 FROM scoped s JOIN embeddings q ON q.vec_id = s.query_id JOIN embeddings e ON e.vec_id IN (SELECT doc_id FROM documents) WHERE scope = 'segment'),
vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, id) AS rank FROM vec),
both_lists AS (SELECT query_id, g, id, rank FROM top UNION ALL SELECT query_id, g, id, rank FROM vtop),
fused AS (SELECT query_id, g, id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM both_lists GROUP BY ALL),
ftop AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 15)
SELECT t.query_id, s.scope, t.rank::BIGINT AS rank, md5(f.body) AS fact_md5 FROM ftop t JOIN scoped s ON s.query_id = t.query_id AND s.g = t.g AND t.rank <= s.keep
JOIN facts f ON f.g = t.g AND f.id = t.id""")
def _(spark, d):
    """The whole search with vectors of the segment's facts and of the queries."""
    facts = inputs.conversation_facts(spark, d)
    vectors = table(spark, d, "embeddings")
    known = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    fact_vectors = vectors.join(known, "vec_id", "left_semi").select(
        F.lit("segment_tribal_gaming").alias("group_id"), F.concat(F.lit("doc-"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("doc_id"), "embedding")
    valid, _ = requests.validate(inputs.search_requests(spark, d), "search")
    hits = search.search_hits(valid, facts, fact_vectors, vectors.select(F.col("vec_id").alias("query_id"), "embedding"))
    return hits.select("query_id", "scope", F.col("rank").cast("long").alias("rank"), F.md5("fact").alias("fact_md5"))


@query("Q5_text_ingest", f"{_DOCS} {sql.FACTS.replace('fact, ep', 'md5(fact) AS fact_md5, ep')}")
def _(spark, d):
    got = ingest.ingest_episodes(inputs.document_requests(spark, d), inputs.benchmark_terms(spark, d), now=fixed_now())
    return got.facts.select("group_id", "uuid", "source_uuid", "target_uuid", "rel_type", "name", F.md5("fact").alias("fact_md5"),
                            F.col("episodes")[0].alias("episode"))


@query("Q5_graph_names", f"WITH {sql.extraction(sql.DOCUMENT_EPISODES, sql.KNOWN_TERMS)} {sql.MENTIONS}")
def _(spark, d):
    """Text whose only gazetteer is what the graphs hold."""
    got = ingest.ingest_episodes(inputs.document_requests(spark, d), None, inputs.known_terms(spark, d), fixed_now())
    return got.mentions


@query("Q6_bootstrap", f"{_BOOT} {sql.EXTRACTION_COUNTS}")
def _(spark, d):
    got, _ = ingest.bootstrap(inputs.bootstrap_requests(spark, d), inputs.benchmark_terms(spark, d), now=fixed_now())
    return ingest.extraction_counts(got)


def _reviewed(spark, d):
    decisions = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("approved"))
    drafts = insights.draft_insights(inputs.findings(spark, d))
    return insights.review(drafts, decisions, "doc_id").withColumns(
        {"industry": F.col("finding_type"), "source_description": F.lit("review"), "ingest_seq": F.col("doc_id")})


@query("Q7_promotion", f"{_PROMOTED} {sql.EXTRACTION_COUNTS}")
def _(spark, d):
    got = insights.promote(_reviewed(spark, d), inputs.benchmark_terms(spark, d), now=fixed_now())
    return ingest.extraction_counts(got)


@query("Q7_review_status", f"""SELECT d.doc_id, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'draft' END AS status
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, d):
    return _reviewed(spark, d).select("doc_id", "status")


# --- streaming and composites ------------------------------------------------------------------------
@query("T1_stream_ingest", f"""{sql.ORDERS_FRESH} SELECT g AS group_id, {sql.stable_id("'fact'", 'ep', 'pos')} AS uuid, src AS source_uuid, tgt AS target_uuid, name
 FROM lnk WHERE src IS NOT NULL AND tgt IS NOT NULL""")
def _(spark, d):
    return stores.streamed_store(spark, d).table("facts").select("group_id", "uuid", "source_uuid", "target_uuid", "name")


@query("C1_ingest_structured", f"{sql.LINES} {sql.COUNTERS}")
def _(spark, d):
    return ingest.ingest_rows(*inputs.line_rows(spark, d)).counters


@query("C2_ingest_episodes", f"{_DOCS} SELECT g AS group_id, uuid, nm AS name, k AS name_lower, seq AS first_seq FROM res WHERE created")
def _(spark, d):
    got = ingest.ingest_episodes(inputs.document_requests(spark, d), inputs.benchmark_terms(spark, d), now=fixed_now())
    return got.entities.select("group_id", "uuid", "name", "name_lower", "first_seq")


@query("C3_bootstrap_mentions", f"{_BOOT} {sql.MENTIONS}")
def _(spark, d):
    got, _ = ingest.bootstrap(inputs.bootstrap_requests(spark, d), inputs.benchmark_terms(spark, d), now=fixed_now())
    return got.mentions


@query("C4_search_insights", f"{sql.SEARCH} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS place, md5(fact) AS insight_md5 FROM hits WHERE scope = 'segment' AND fact <> ''")
def _(spark, d):
    got = search.search_context(inputs.search_requests(spark, d), inputs.conversation_facts(spark, d))
    each = got.select("query_id", F.posexplode("segment_insights").alias("place", "insight"))
    return each.select("query_id", (F.col("place") + 1).cast("long").alias("place"), F.md5("insight").alias("insight_md5"))


@query("C5_graph_view_edges", f"{sql.view(200)} SELECT g AS group_id, id, source, target, label, fact FROM vy")
def _(spark, d):
    return _region_view(spark, d).edges


@query("C6_stored_view_edges", f"""{sql.LINES}, ents AS (SELECT g, uuid FROM res WHERE created QUALIFY row_number() OVER (PARTITION BY g ORDER BY uuid) <= 500),
fct AS (SELECT g, src, tgt, {sql.stable_id("'fact'", 'ep', 'pos')} AS eid, fact FROM lnk WHERE src IS NOT NULL AND tgt IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY g ORDER BY {sql.stable_id("'fact'", 'ep', 'pos')}) <= 1000)
SELECT g AS group_id, src || '-RELATES_TO-' || tgt AS id, src AS source, tgt AS target, 'RELATES_TO' AS label, fact FROM fct
WHERE (g, src) IN (SELECT g, uuid FROM ents) AND (g, tgt) IN (SELECT g, uuid FROM ents) QUALIFY row_number() OVER (PARTITION BY g, src, tgt ORDER BY eid) = 1""")
def _(spark, d):
    return stored_line_view(spark, d).edges


@query("C7_promoted_facts", f"{_PROMOTED} {sql.FACTS.replace('fact, ep', 'md5(fact) AS fact_md5, ep')}")
def _(spark, d):
    got = insights.promote(_reviewed(spark, d), inputs.benchmark_terms(spark, d), now=fixed_now())
    return got.facts.select("group_id", "uuid", "source_uuid", "target_uuid", "rel_type", "name", F.md5("fact").alias("fact_md5"),
                            F.col("episodes")[0].alias("episode"))


def stored_line_view(spark, d):
    """Lines of all orders ingested, then exported per graph: the flagship query."""
    got = ingest.ingest_rows(*inputs.line_rows(spark, d))
    return graph_view.stored_view(got.entities, got.facts)
