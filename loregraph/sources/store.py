"""Stored graphs: append-only Parquet tables, partitioned by graph and ingest batch.

Every batch writes its own partitions and overwrites them when it is replayed, so a
restarted stream adds nothing twice and needs no look-up of what was written before.
Dropping a graph removes its partition folders.

Compaction writes all visible batches as one, out of sight, and then commits a list of the batches
it replaces under the next version number. Readers go by the newest list: they see the batches
before, or the one after, never both or neither. Of two compactions at the same time one commits
and the other is undone. Replaced folders stay until ``vacuum``, for readers that began before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph import schemas
from loregraph.functions import domains, keys
from loregraph.operators.resolve import Resolution
from loregraph.operators.scale import of_groups
from loregraph.session import materialize

DELETES = 16  # folders deleted side by side
FEW_GRAPHS = 16  # a batch of so few graphs isn't shuffled by graph: each task writes a file per graph
LISTS = "compactions"
LIST = "batch_id string, replaced boolean"


class CompactionConflict(RuntimeError):
    """Another compaction was committed first; nothing was changed."""


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, pinned: DataFrame | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.pinned = pinned
        for table in (*schemas.TABLES, "graphs", "batches", LISTS):
            self._fs(table).mkdirs(self._path(table))

    # --- reading ---------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """A stored table; of the batches, only those that were written to the end are visible."""
        if name == "graphs":
            return self.spark.read.schema(schemas.GRAPHS).parquet(f"{self.root}/graphs")
        schema = schemas.TABLES[name]
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        # A row per batch: Spark broadcasts it while it is small, and then skips the folders of others.
        whole = self.visible_batches() if self.pinned is None else self.pinned
        return rows.join(whole, "batch_id", "left_semi").select(*schema.fieldNames())

    def visible_batches(self) -> DataFrame:
        """``batch_id`` of what readers see: batches with a marker that no compaction replaced, and compacted ones."""
        marked = self.spark.read.schema(schemas.BATCHES).parquet(f"{self.root}/batches").select("batch_id")
        _, folder = self._newest()
        if folder is None:
            return marked
        listed = self.spark.read.schema(LIST).parquet(f"{self.root}/{LISTS}/{folder}")
        return marked.join(listed.filter("replaced"), "batch_id", "left_anti").unionByName(listed.filter("NOT replaced").select("batch_id"))

    def snapshot(self) -> GraphStore:
        """The store as it is now, in all tables alike; what is committed later isn't seen. The list of visible
        batches is held by the driver: compaction keeps it short."""
        ids = [(r.batch_id,) for r in self.visible_batches().collect()]
        return GraphStore(self.spark, self.root, self.spark.createDataFrame(ids, "batch_id string"))

    def entities_for(self, groups: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Entities a batch resolves against: those of its graphs written by other batches."""
        found = of_groups(self.table("entities"), groups)
        return found if batch_id is None else found.filter(F.col("batch_id") != batch_id)

    def list_graphs(self) -> DataFrame:
        # Two batches may list a new graph at the same time.
        return self.table("graphs").select("group_id", "kind").distinct()

    def graph_count(self) -> int:
        return self.list_graphs().count()

    def graph_sizes(self) -> DataFrame:
        """Every listed graph with its row counts, zero for an empty one."""
        names = ["episodes", "entities", "mentions", "facts"]
        rows = self.list_graphs().select("group_id", F.lit(True).alias("listed"), F.lit(None).cast("string").alias("t"))
        for name in names:
            rows = rows.union(self.table(name).select("group_id", F.lit(False), F.lit(name)))
        counts = [F.count_if(F.col("t") == n).alias(n) for n in names]
        return rows.groupBy("group_id").agg(F.max("listed").alias("listed"), *counts).filter("listed").drop("listed")

    # --- writing ---------------------------------------------------------
    def append(self, result: Resolution, batch_id: str | None = None, now: Column | None = None) -> str:
        """Write one ingest. Its marker goes last, and makes the batch visible to readers.

        The sinks do not depend on each other and are written side by side, so that
        one's last tasks leave no executor idle.
        """
        batch_id = batch_id or f"b{uuid.uuid4().hex}"
        now = one_time() if now is None else now
        groups = materialize(result.episodes.select("group_id").distinct())
        self.register(groups, now)
        gather = groups.limit(FEW_GRAPHS + 1).count() > FEW_GRAPHS
        none = F.lit(None).cast(schemas.PROPERTIES)
        episodes = result.episodes.withColumn("source", F.lit("text")).withColumnsRenamed(
            {"episode_uuid": "uuid", "seq": "ingest_seq"}
        )
        sinks = {
            "entities": result.entities.withColumn("properties", none), "mentions": result.mentions, "facts": result.facts,
            "episodes": episodes,
        }
        with ThreadPoolExecutor(len(sinks)) as pool:
            jobs = [pool.submit(self._write, table, rows, batch_id, now, gather) for table, rows in sinks.items()]
            for job in jobs:
                job.result()
        done = self.spark.range(1).select(now.alias("committed_at"))
        done.write.mode("overwrite").parquet(f"{self.root}/batches/batch_id={batch_id}")
        return batch_id

    def _write(self, table: str, rows: DataFrame, batch_id: str, now: Column, gather: bool = True) -> None:
        """With ``gather`` one graph goes to few files; AQE splits a graph too large for one task."""
        stamped = rows if "created_at" in rows.columns else rows.withColumn("created_at", now)
        stamped = stamped.withColumn("batch_id", F.lit(batch_id)).select(*schemas.TABLES[table].fieldNames())
        (
            (stamped.hint("rebalance", "group_id") if gather else stamped)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("group_id", "batch_id").parquet(f"{self.root}/{table}")
        )

    def register(self, groups: DataFrame, now: Column | None = None) -> None:
        """List graphs that are not listed yet."""
        now = one_time() if now is None else now
        new = groups.select("group_id").distinct().join(self.list_graphs(), "group_id", "left_anti")
        kind = F.when(F.col("group_id").startswith("segment_"), F.lit("segment")).otherwise(F.lit("client"))
        rows = new.select(kind.alias("kind"), now.alias("created_at"), "group_id")
        rows.write.mode("append").partitionBy("group_id").parquet(f"{self.root}/graphs")

    # --- maintenance ---------------------------------------------------------
    def compact(self) -> str | None:
        """Rewrite all visible batches as one, with files of a graph together; its id, or None if there is
        nothing to merge. Batches committed meanwhile stay as they are."""
        version, folder = self._newest()
        seen = self.snapshot()
        old = [r.batch_id for r in seen.pinned.collect()]
        if len(old) < 2:
            return None
        merged = f"c{uuid.uuid4().hex}"
        with ThreadPoolExecutor(len(schemas.TABLES)) as pool:
            jobs = [pool.submit(self._write, name, seen.table(name).drop("batch_id"), merged, one_time()) for name in schemas.TABLES]
            for job in jobs:
                job.result()
        before = [] if folder is None else [r.batch_id for r in self.spark.read.schema(LIST).parquet(f"{self.root}/{LISTS}/{folder}").filter("replaced").collect()]
        rows = [(b, True) for b in dict.fromkeys([*before, *old])] + [(merged, False)]
        own = uuid.uuid4().hex
        self.spark.createDataFrame(rows, LIST).coalesce(1).write.parquet(f"{self.root}/{LISTS}/{own}")
        if not self._commit(version + 1, own):
            self._drop_batches([merged])
            self._fs(LISTS).delete(self._path(f"{LISTS}/{own}"), True)
            raise CompactionConflict(f"version {version + 1} was committed by another compaction")
        return merged

    def vacuum(self) -> int:
        """Remove the folders of replaced batches; their number. To be called once no reader that began before
        the compaction is left. The ids stay listed, so that a late replay of such a batch isn't seen."""
        _, folder = self._newest()
        if folder is None:
            return 0
        old = [r.batch_id for r in self.spark.read.schema(LIST).parquet(f"{self.root}/{LISTS}/{folder}").filter("replaced").collect()]
        self._drop_batches(old)
        return len(old)

    def _newest(self) -> tuple[int, str | None]:
        """Version of the newest committed list and its folder."""
        found = self._fs(LISTS).globStatus(self._path(f"{LISTS}/v*.commit"))
        names = sorted(f.getPath().getName() for f in found) if found else []
        if not names:
            return 0, None
        stream = self._fs(LISTS).open(self._path(f"{LISTS}/{names[-1]}"))
        try:
            return int(names[-1][1:-len(".commit")]), stream.readUTF()
        finally:
            stream.close()

    def _commit(self, version: int, folder: str) -> bool:
        """Point ``version`` to a list unless it is taken: the file is created only if there is none."""
        try:
            stream = self._fs(LISTS).create(self._path(f"{LISTS}/v{version:012d}.commit"), False)
        except Py4JJavaError:
            return False
        stream.writeUTF(folder)
        stream.close()
        return True

    def _drop_batches(self, batches: list[str]) -> None:
        def drop(table: str, batch: str) -> None:
            fs = self._fs(table)
            for found in fs.globStatus(self._path(f"{table}/group_id=*/batch_id={batch}")) or []:
                fs.delete(found.getPath(), True)

        with ThreadPoolExecutor(DELETES) as pool:
            for _ in pool.map(lambda job: drop(*job), [(t, b) for b in batches for t in schemas.TABLES]):
                pass

    # --- administration ----------------------------------------------------
    def init_graphs(self, requests: DataFrame) -> DataFrame:
        """Idempotent; one row per request."""
        named = requests.select(keys.client_graph("client_slug").alias("group_id"))
        self.register(named)
        return named.select(F.col("group_id").alias("graph_name"), F.lit("initialized").alias("status"))

    def reset_graphs(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Empty the confirmed graphs and keep them listed; (done, rejected)."""
        confirmed, rejected = confirm(requests)
        named = confirmed.select(keys.client_graph("client_slug").alias("group_id"))
        self._drop(named, schemas.TABLES)
        self.register(named)
        done = named.select(F.col("group_id").alias("graph_name"), F.lit("reset_and_reinitialized").alias("status"))
        return done, rejected

    def delete_graphs(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Remove the confirmed graphs altogether; (done, rejected)."""
        confirmed, rejected = confirm(requests)
        named = confirmed.select(keys.client_graph("client_slug").alias("group_id"))
        self._drop(named, (*schemas.TABLES, "graphs"))
        return named.select(F.col("group_id").alias("graph_name"), F.lit("deleted").alias("status")), rejected

    def _drop(self, groups: DataFrame, tables: Iterable[str]) -> None:
        # Graph keys are letters, digits and underscores, so they are folder names as they are.
        def drop(group: str) -> None:
            for table in tables:
                self._fs(table).delete(self._path(f"{table}/group_id={group}"), True)

        with ThreadPoolExecutor(DELETES) as pool:
            pending: set = set()
            for row in groups.distinct().toLocalIterator():
                pending.add(pool.submit(drop, row.group_id))
                if len(pending) >= 8 * DELETES:  # however many graphs, few are held here
                    done, pending = wait(pending, return_when=FIRST_COMPLETED)
                    for job in done:
                        job.result()
            for job in pending:
                job.result()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())


def one_time() -> Column:
    """The present as a constant, so that all jobs of a batch write the same time."""
    return F.lit(datetime.now(timezone.utc).isoformat()).cast("timestamp")


def confirm(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split destructive requests by the exact confirm sentence into (confirmed, rejected)."""
    agreed = F.coalesce(F.col("confirm") == domains.CONFIRM_SENTENCE, F.lit(False))
    return requests.filter(agreed), requests.filter(~agreed)
