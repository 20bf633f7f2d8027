"""A small relational store on Parquet: a table is a list of folders, and a log names the lists of each version.

A change writes its rows aside and then names the next version, all its tables in one step; an insert adds a folder, and many small ones are merged
with the next insert. Constraints are kept by the write helpers: ids, unique keys, cascades. No statement overwrites files that it reads.

Naming a version is a rename that must not overwrite: of two writers one gets a ``Conflict`` and ``change`` starts anew from the other's
version. File systems whose rename is not atomic (object stores without conditional writes) allow one writer at a time only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the stored tables and their unique keys.
TABLES = {
    "_schema_versions": ("version int, applied_at timestamp", ["version"]),
    "prompts": ("id long, name string, strategy string, system_prompt string, user_template string, version string, is_active boolean, created_at timestamp, updated_at timestamp", ["name", "version"]),
    "search_history": ("id long, query string, strategy string, provider string, results_count int, created_at timestamp, settings string, status string, execution_ms long", ["id"]),
    "analysis_results": ("id long, search_id long, patent_number string, strategy string, prompt string, result string, model string, provider string, input_tokens long, output_tokens long, created_at timestamp", ["id"]),
    "patent_cache": ("patent_number string, title string, abstract string, claims string, source string, raw string, cached_at timestamp", ["patent_number"]),
    "search_candidates": ("id long, search_id long, patent_number string, title string, abstract string, source string, url string, url_valid boolean, bm25_score double, vector_score double, rrf_score double, stage1_rank int, doc string", ["search_id", "patent_number"]),
    "rerank_results": ("id long, search_id long, candidate_id long, weighted_score double, element_scores string, novelty_threat boolean, inventive_threat boolean, reasoning string, stage2_rank int", ["id"]),
    "claim_charts": ("id long, search_id long, patent_number string, chart_json string, created_at timestamp", ["id"]),
    "projects": ("id long, name string, description string, created_at timestamp, updated_at timestamp", ["id"]),
    "project_workspace": ("id long, project_id long, claim_text string, structure string, nodes string, edges string, updated_at timestamp", ["project_id"]),
    "project_searches": ("id long, project_id long, search_id long, linked_at timestamp", ["project_id", "search_id"]),
}

#: Children that go with a deleted row: table -> [(child, its column)].
CASCADES = {
    "projects": [("project_workspace", "project_id"), ("project_searches", "project_id")],
    "search_history": [("analysis_results", "search_id"), ("search_candidates", "search_id"), ("rerank_results", "search_id"), ("claim_charts", "search_id"), ("project_searches", "search_id")],
    "search_candidates": [("rerank_results", "candidate_id")],
}


class Conflict(RuntimeError):
    """Another writer committed this version first: read again and repeat the write."""


def with_ids(rows: DataFrame, order: list[str], highest: int = 0, name: str = "id") -> DataFrame:
    """Rows numbered on from ``highest`` in an order: for the batches that a store appends, not for a corpus."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") + F.lit(highest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows with those of equal keys replaced by the last new one (by ``order``)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *([F.desc(order)] if order else []))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows, and the first new one (by ``order``) of each key that is not there."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Optional columns: a null in ``changes`` leaves the old value."""
    names = [c for c in changes.columns if c != key]
    joined = df.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in names)), key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def activate(df: DataFrame, group: str, key: str, chosen: DataFrame) -> DataFrame:
    """is_active for the chosen (group, key) alone within its group; other groups stay."""
    pick = chosen.select(F.col(group).alias("_g"), F.col(key).alias("_k"))
    joined = df.join(pick, F.col(group) == F.col("_g"), "left")
    return joined.withColumn("is_active", F.when(F.col("_g").isNull(), F.col("is_active")).otherwise(F.col(key) == F.col("_k"))).drop("_g", "_k")


def delete(df: DataFrame, gone: DataFrame, column: str, key: str = "id") -> DataFrame:
    return df.join(gone.select(F.col(key).alias(column)), column, "left_anti").select(*df.columns)


def recent(df: DataFrame, n: int, time: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def token_totals(df: DataFrame, tokens_in: str = "input_tokens", tokens_out: str = "output_tokens") -> DataFrame:
    return df.agg(
        F.coalesce(F.sum(tokens_in), F.lit(0)).cast("long").alias("total_input"), F.coalesce(F.sum(tokens_out), F.lit(0)).cast("long").alias("total_output"), F.count("*").alias("count")
    )


#: Folders of a table; one more is merged with the others.
FOLDERS = 16


@dataclass
class Append:
    """Rows that a commit adds to a table."""

    rows: DataFrame


class Store:
    """Tables under ``path``. ``commit`` writes new versions of several tables and then names them in one step; a failure before leaves the old."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        logs = self._p(f"{self.path}/_log")
        if not self.fs.exists(logs):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(logs)]
        return sorted(int(n[:-2]) for n in names if n.endswith(".v"))

    def _version(self) -> int:
        """The last version named, -1 before the first."""
        return max(self._versions(), default=-1)

    def _folders(self, version: int) -> dict[str, list[str]]:
        """The folders of each table, in the order in which they were added."""
        if version < 0:
            return {}
        out: dict[str, list[str]] = {}
        for r in self.spark.read.schema("name string, folder string, place int").json(f"{self.path}/_log/{version:09d}.v").orderBy("name", "place").collect():
            out.setdefault(r.name, []).append(r.folder)
        return out

    def _p(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        schema, _ = TABLES[name]
        folders = self._folders(self._version() if version is None else version).get(name)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _aligned(self, name: str, df: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], TABLES[name][0])
        return df.select(*(F.col(f.name).cast(f.dataType) for f in want.schema.fields))

    def appended(self, name: str, rows: DataFrame) -> Append:
        """Rows to be added to a table: missing times are now, other missing columns null."""
        for f in self.spark.createDataFrame([], TABLES[name][0]).schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.current_timestamp() if f.name.endswith("_at") else F.lit(None).cast(f.dataType))
        return Append(rows)

    def _repeated(self, name: str, folder: str, others: list[str]) -> bool:
        """Whether rows of a new folder repeat a key, among themselves or of the table's other folders (whose key columns alone are read)."""
        _, keys = TABLES[name]
        new = self.spark.read.schema(TABLES[name][0]).parquet(folder).select(*keys)
        if new.groupBy(*keys).count().filter("count > 1").head():
            return True
        return bool(others) and bool(self.spark.read.schema(TABLES[name][0]).parquet(*others).select(*keys).join(new, keys, "left_semi").head())

    def commit(self, base: int | None = None, **tables: DataFrame | Append) -> dict[str, str]:
        """Name the next version after ``base`` (the last one): whole tables, or ``Append``s to them. Gives the folders written."""
        version = self._version() if base is None else base
        names = self._folders(version)
        written = {}
        for name, value in tables.items():
            written[name] = folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
            old = names.get(name, []) if isinstance(value, Append) else []
            self._aligned(name, value.rows if isinstance(value, Append) else value).write.parquet(folder)
            if self._repeated(name, folder, old):
                raise ValueError(f"{name}: repeated {TABLES[name][1]}")
            if len(old) >= FOLDERS:
                whole = f"{self.path}/{name}/{uuid.uuid4().hex}"
                self.spark.read.schema(TABLES[name][0]).parquet(*old, folder).coalesce(1 + len(old) // FOLDERS).write.parquet(whole)
                names[name] = [whole]
            else:
                names[name] = [*old, folder]
        temp = f"{self.path}/_temp/{uuid.uuid4().hex}"
        rows = [(name, folder, k) for name, folders in names.items() for k, folder in enumerate(folders)]
        self.spark.createDataFrame(rows, "name string, folder string, place int").coalesce(1).write.json(temp)
        self.fs.mkdirs(self._p(f"{self.path}/_log"))
        self._claim(temp, f"{self.path}/_log/{version + 1:09d}.v")
        return written

    def change(self, make: Callable[[], dict[str, DataFrame | Append]], attempts: int = 5) -> dict[str, str]:
        """Commit what ``make`` builds from the tables; after a conflict it builds anew from the version that was first."""
        for n in range(1, attempts + 1):
            base = self._version()
            try:
                return self.commit(base, **make())
            except Conflict:
                if n == attempts:
                    raise
                time.sleep(0.05 * n)
        raise AssertionError("attempts must be positive")

    def _claim(self, source: str, target: str) -> None:
        """Rename without overwriting: of two writers of a version one gets a Conflict."""
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._p(source), self._p(target), options)
        except Py4JJavaError as e:
            if self.fs.exists(self._p(target)):
                raise Conflict(target) from e
            raise

    def insert(self, name: str, rows: DataFrame, order: list[str]) -> list[int]:
        """Append rows under new ids, and give these back."""

        def made() -> dict[str, Append]:
            high = self.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            return {name: self.appended(name, with_ids(rows, order, high))}

        folder = self.change(made)[name]
        return [r.id for r in self.spark.read.parquet(folder).select("id").orderBy("id").collect()]

    def delete(self, name: str, key: int) -> None:
        """Delete a row and, down all levels, the rows that belong to it."""

        def made() -> dict[str, DataFrame]:
            gone = self.table(name).filter(F.col("id") == key).select("id")
            changed: dict[str, DataFrame] = {name: self.table(name).filter(F.col("id") != key)}
            level = [(name, gone)]
            while level:
                deeper = []
                for parent, ids in level:
                    for child, column in CASCADES.get(parent, []):
                        now = changed.get(child, self.table(child))
                        changed[child] = delete(now, ids, column)
                        deeper.append((child, now.join(ids.select(F.col("id").alias(column)), column, "left_semi").select("id")))
                level = deeper
            return changed

        self.change(made)

    def vacuum(self, versions: int = 2, seconds: float = 3600) -> int:
        """Delete logs but the last ``versions``, and folders older than ``seconds`` that these do not name; how many folders went."""
        logs = self._versions()
        keep = {folder.rsplit("/", 1)[1] for v in logs[-versions:] for folders in self._folders(v).values() for folder in folders}
        for v in logs[:-versions]:
            self.fs.delete(self._p(f"{self.path}/_log/{v:09d}.v"), True)
        gone, before = 0, (time.time() - seconds) * 1000
        for name in [*TABLES, "_temp"]:
            at = self._p(f"{self.path}/{name}")
            for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if s.getPath().getName() not in keep and s.getModificationTime() <= before:
                    self.fs.delete(s.getPath(), True)
                    gone += 1
        return gone
