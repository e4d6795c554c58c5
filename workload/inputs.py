"""The given tables as inputs of the engine. Nothing here is sampled or cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph import schemas
from loregraph.functions import keys
from loregraph.operators.scale import LOOKUP_ROWS, in_slices, is_small, spread
from loregraph.session import materialize

_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its files are listed and its schema read once per session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _TABLES:
        df = spark.read.parquet(key[1])
        # The given files hold one row group each, which only one task can read.
        df = spread(df, df.columns[0])
        zoned = [
            F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
            for f in df.schema.fields
        ]
        _TABLES[key] = df.select(*zoned)
    return _TABLES[key]


def _entity(name, kind, description):
    return F.struct(name.alias("name"), kind.alias("type"), description.alias("description"))


def _relation(source, target, relation, fact):
    return F.struct(
        source.alias("source"), target.alias("target"), relation.alias("relation"), fact.alias("fact")
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested structured request per order; the graph is the customer's market segment.

    Priorities recur in three spellings, so one name is shared by a fifth of all orders. The
    second relationship starts at the *next* customer, known only if seen before.
    """
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    following = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0"))
    spelled = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("  "), F.lower("o_orderpriority")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.col("o_orderpriority"), F.lit(" \n")))
        .otherwise(F.col("o_orderpriority"))
    )
    status = F.concat(F.lit("Status "), F.col("o_orderstatus"))
    lit = F.lit
    return rows.select(
        F.col("c_mktsegment").alias("client_slug"),
        F.concat(lit("order: "), F.col("o_orderkey").cast("string")).alias("episode_name"),
        lit("orders").alias("source_description"),
        F.col("o_orderdate").alias("reference_time"),
        F.array(
            _entity(F.col("c_name"), lit("Stakeholder"), F.concat(lit(" customer of "), F.col("c_mktsegment"))),
            _entity(spelled, lit("Process"), lit("order priority")),
            _entity(status, lit(""), lit("")),
            _entity(lit("  "), lit("Role"), lit("blank names are skipped")),
            _entity(F.upper(status), lit(" System "), lit("again")),
        ).alias("entities"),
        F.array(
            _relation(F.col("c_name"), F.lower("o_orderpriority"), lit(" places "), lit("")),
            _relation(following, F.upper(status), lit(""), lit("precedes")),
            _relation(following, F.col("c_name"), lit("  "), lit("")),
        ).alias("relationships"),
        F.col("o_orderkey").alias("ingest_seq"),
    )


def stored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities stored by some other path: customers in debt, upper-cased, some of them twice."""
    debtors = table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    key = keys.client_graph("c_mktsegment").alias("group_id")
    first = debtors.select(
        key, F.concat(F.lit("stored-"), F.col("c_custkey").cast("string")).alias("uuid"),
        F.upper("c_name").alias("name"), F.lit("2020-01-02 00:00:00").cast("timestamp").alias("created_at"),
    )
    older = debtors.filter("c_acctbal < -500").select(
        key, F.concat(F.lit("older-"), F.col("c_custkey").cast("string")), F.col("c_name"),
        F.lit("2020-01-01 00:00:00").cast("timestamp"),
    )
    return first.union(older)


def line_rows(spark: SparkSession, sf_dir: str, staged: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat rows of one episode per order: its lines name a part and a supplier and link them.

    ``staged`` writes the joined lines once for all frames that read them, a slice of the orders at a time, so
    the disk holds what the joins of one slice shuffle."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        keys.client_graph("c_mktsegment").alias("group_id"), F.col("o_orderkey").alias("seq"), "o_orderdate",
    )
    name = F.concat(F.lit("order: "), F.col("seq").cast("string"))
    episode = keys.episode_id("group_id", "seq", name).alias("episode_uuid")
    episodes = named.select(
        "group_id", episode, "seq", name.alias("name"), F.lit("").alias("content"),
        F.lit("lines").alias("source_description"), F.col("o_orderdate").alias("valid_at"),
        F.col("o_orderdate").alias("created_at"),
    )
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    small = is_small(supplier, LOOKUP_ROWS)

    def joined(lines: DataFrame) -> DataFrame:
        # Of the joins that shuffle the one with orders comes last: the lines of an order lie together, and what
        # is counted by order shrinks before it is shuffled.
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        if not small:
            lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        lines = lines.join(named.select("group_id", "seq"), F.col("l_orderkey") == F.col("seq"))
        if small:
            lines = lines.join(F.broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.select("group_id", "seq", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_type", "p_brand", "s_name")

    lines = materialize(*map(joined, in_slices(lineitem, "l_orderkey"))) if staged else joined(lineitem)
    lines = lines.withColumn("episode_uuid", episode)
    at = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")) * 10_000_000 + F.col("l_suppkey")
    head = ["group_id", "episode_uuid", "seq"]
    # One pass over the joined lines gives both entity rows.
    both = F.array(
        F.struct((at * 2).alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
                 F.col("p_brand").alias("description")),
        F.struct((at * 2 + 1).alias("pos"), F.col("s_name").alias("name"), F.lit("Stakeholder").alias("type"),
                 F.lit("supplier").alias("description")),
    )
    entities = lines.select(*head, F.explode(both).alias("e")).select(*head, "e.*")
    relationships = lines.select(
        *head, at.alias("pos"), F.col("s_name").alias("source"), F.col("p_name").alias("target"),
        F.lit("supplies").alias("relation"), F.lit("").alias("fact"),
    )
    return episodes, entities, relationships


def document_requests(spark: SparkSession, sf_dir: str, short_notes: bool = False) -> DataFrame:
    """Documents as text episode requests; with ``short_notes``, short ones carry a type nobody knows."""
    kind = F.lit("document_analysis")
    if short_notes:
        kind = F.when(F.col("n_chars") < 300, F.lit("note")).otherwise(kind)
    docs = table(spark, sf_dir, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return docs.select(
        F.concat(F.lit("Lang-"), F.col("lang")).alias("client_slug"), F.col("source").alias("engagement_id"),
        kind.alias("episode_type"),
        F.col("text").alias("content"), F.col("doc_id").cast("string").alias("source_id"),
        F.lit("document").alias("source_type"),
        F.when(
            F.col("lang") == "en",
            F.create_map(F.lit("lang"), "lang", F.lit("chars"), F.col("n_chars").cast("string")),
        ).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), start).alias("timestamp"),
        F.col("doc_id").alias("ingest_seq"),
    )


def bootstrap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per document: the text under its name, and its language without one."""
    docs = table(spark, sf_dir, "documents")
    full = F.create_map(
        F.lit("name"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.lit("content"), "text",
        F.lit("category"), "source", F.lit("timestamp"), F.lit("2024-03-01 00:00:00"),
    )
    bare = F.create_map(F.lit("content"), "lang")
    return docs.select(
        F.concat(F.lit("boot "), F.col("lang")).alias("client_slug"), F.col("source").alias("engagement_id"),
        F.array(full, bare).alias("documents"), F.col("doc_id").alias("ingest_seq"),
    )


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer terms: the opening three and the opening twelve words of every benchmark sentence."""
    sentence = F.explode(F.split("text", r"[.!?\n]+")).alias("s")
    words = F.array_remove(F.split(F.trim("s"), " "), "")
    openings = F.explode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (3, 12)])).alias("name")
    return (
        table(spark, sf_dir, "benchmark").select(sentence).select(openings).filter("name <> ''").distinct()
        .withColumn("type", F.lit("Finding"))
    )


def known_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names as entities stored in the graph of every language, without any gazetteer."""
    graphs = table(spark, sf_dir, "documents").select(keys.client_graph(F.concat(F.lit("Lang-"), "lang")).alias("group_id")).distinct()
    groups = F.array(*[F.lit(r.group_id) for r in graphs.collect()])
    at = F.lit("2020-01-01 00:00:00").cast("timestamp").alias("created_at")
    return benchmark_terms(spark, sf_dir).select(
        F.explode(groups).alias("group_id"), F.concat(F.lit("known-"), F.md5("name")).alias("uuid"), "name", at)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings, with the amount and date of the order of the same number, if any, appended."""
    docs = table(spark, sf_dir, "documents")
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "M/d/yyyy")
    tail = F.concat(
        F.lit(" paid $"), F.format_number("o_totalprice", 2), F.lit(" on "), day,
        F.lit(" call 555-010-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"),
    )
    day, tail = F.coalesce(day, F.lit("no day")), F.coalesce(tail, F.lit(""))
    return docs.join(orders, F.col("doc_id") == F.col("o_orderkey"), "left").select(
        "doc_id", F.concat(F.lit("Finding on "), day, F.lit(" in "), F.col("lang")).alias("title"),
        F.concat(F.col("text"), tail).alias("content"), F.col("source").alias("type"),
        F.lit("Tion").alias("client_name"), F.array(F.lit("The ON"), F.lit("lich")).alias("known_names"),
    )


def conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts: conversation turns per role, and all documents in the default segment graph."""
    none = F.lit(None).cast("timestamp")
    turns = table(spark, sf_dir, "conversations").select(
        keys.client_graph("role").alias("group_id"),
        F.concat_ws("-", F.lit("turn"), F.lpad(F.col("conv_id").cast("string"), 9, "0"),
                    F.lpad(F.col("turn").cast("string"), 6, "0")).alias("uuid"),
        F.col("conv_id").cast("string").alias("source_uuid"), F.col("turn").cast("string").alias("target_uuid"),
        F.lit("RELATES_TO").alias("rel_type"), F.col("role").alias("name"), F.col("text").alias("fact"),
        none.alias("valid_at"), none.alias("invalid_at"), none.alias("expired_at"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("segment_tribal_gaming"), F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")),
        F.col("source"), F.col("lang"), F.lit("RELATES_TO"), F.lit("observes"), F.col("text"), none, none, none,
    )
    return turns.union(docs)


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    size = F.length("text")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(size % 3 == 0, F.lit("Assistant")).when(size % 3 == 1, F.lit("User")).otherwise(F.lit("nobody")).alias("client_slug"),
        F.lit("e1").alias("engagement_id"), F.col("text").alias("query"),
        (size % 53).cast("int").alias("max_results"), (size % 2 == 0).alias("include_segment"),
        F.lit(None).cast("string").alias("industry"),
    )


def region_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph per region: its nations and customers, and orders as episodic nodes."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key, lit = keys.client_graph("r_name").alias("group_id"), F.lit
    no_list = lit(None).cast("array<string>")

    def text(c):
        return F.col(c).cast("string")

    def props(*pairs):
        return F.create_map(*[x for name, value in pairs for x in (lit(name), value)]).cast(schemas.PROPERTIES)

    regions = region.select(
        key, text("r_regionkey").cast("long").alias("native_id"), F.array(lit("Location")).alias("node_labels"),
        no_list.alias("labels"), props(("id", F.concat(lit("r"), text("r_regionkey"))), ("name", F.col("r_name"))).alias("properties"),
    )
    nation_rows = nations.select(
        key, (F.col("n_nationkey") + 100).cast("long"), F.array(lit("Entity"), lit("Extra")), no_list,
        props(("label", F.col("n_name")), ("labels", lit("['Department', 'Unit']")), ("content", lit("long"))),
    )
    kinds = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.array(lit("System"), lit("Other")))
        .when(F.col("c_mktsegment") == "BUILDING", F.array().cast("array<string>"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(lit("Household")))
    )
    summary = F.when(F.col("c_acctbal") < 0, lit("Payment Problem")).otherwise(lit("Workflow ok"))
    customer_rows = customers.select(
        key, F.col("c_custkey") + 1000, F.array(lit("Entity")), kinds,
        props(("uuid", F.concat(lit("c"), F.lpad(text("c_custkey"), 9, "0"))), ("name", F.col("c_name")),
              ("summary", summary), ("source", lit("table"))),
    )
    order_rows = placed.select(
        key, F.col("o_orderkey") + 10_000_000, F.array(lit("Episodic")), no_list,
        props(("uuid", F.concat(lit("o"), text("o_orderkey"))), ("name", F.concat(lit("order "), text("o_orderkey")))),
    )
    return regions.union(nation_rows).union(customer_rows).union(order_rows)


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> nation twice under one relation type, nation -> region, order -> customer."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key, lit = keys.client_graph("r_name").alias("group_id"), F.lit
    none, no_id = lit(None).cast("string"), lit(None).cast("long")
    cust = F.concat(lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))

    def tag(prefix, column):
        return F.concat(lit(prefix), F.lpad(F.col(column).cast("string"), 9, "0"))

    both = F.explode(F.array(
        F.struct(tag("a", "c_custkey").alias("edge_uuid"), F.concat(lit("owes "), F.col("c_mktsegment")).alias("fact")),
        F.struct(tag("b", "c_custkey").alias("edge_uuid"), lit(None).cast("string").alias("fact")),
    )).alias("e")
    lives = customers.select(
        key, cust.alias("source_uuid"), none.alias("source_id"), no_id.alias("source_native"),
        lit("").alias("target_uuid"), none.alias("target_id"), (F.col("n_nationkey") + 100).cast("long").alias("target_native"),
        lit("RELATES_TO").alias("rel_type"), both,
    ).select("group_id", "source_uuid", "source_id", "source_native", "target_uuid", "target_id", "target_native",
             "rel_type", "e.fact", "e.edge_uuid")
    part_of = nations.select(
        key, none, none, (F.col("n_nationkey") + 100).cast("long"), none,
        F.concat(lit("r"), F.col("r_regionkey").cast("string")), no_id, none, lit("part of"), tag("0", "n_nationkey"),
    )
    mention = placed.select(
        key, F.concat(lit("o"), F.col("o_orderkey").cast("string")), none, no_id, cust, none, no_id,
        lit("MENTIONS"), none, tag("m", "o_orderkey"),
    )
    return lives.union(part_of).union(mention)


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("doc_id"), "embedding"
    )
