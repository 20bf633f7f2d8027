"""The callable surface: nouns with their verbs, over one store."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, chunking, claims, staging, store
from ..sources import replies as sources
from . import bundles, providers, report, run, search, workspace


class App:
    def __init__(self, spark: SparkSession, path: str, provider: providers.Provider | None = None):
        self.spark = spark
        self.store = store.Store(spark, path)
        self.provider = provider or providers.StubProvider()
        self.settings: dict = {}
        self.registry = sources.SourceRegistry()
        self.factory = providers.ProviderFactory()
        self.running: dict[int, workspace.Cancel] = {}
        #: Sources that may be asked; all registered ones if none are named.
        self.allowed: list[str] = []

    def _row(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], list(values))

    # settings and prompts

    def get_settings(self) -> search.Settings:
        return search.merged(self.settings, {})

    def update_settings(self, **patch) -> search.Settings:
        self.settings |= patch
        return self.get_settings()

    def seed_prompts(self) -> None:
        new = providers.missing_prompts(self.store.table("prompts"), providers.default_prompts(self.spark))
        if new.head():
            self.store.insert("prompts", new, ["name", "version"])

    def list_prompts(self, strategy: str | None = None) -> DataFrame:
        return providers.prompts_of(self.store.table("prompts"), strategy)

    def save_prompt(self, name: str, version: str, strategy: str, template: str) -> None:
        """Update the prompt of this name and version, which keeps its strategy, or add it."""
        table = self.store.table("prompts")
        here = (F.col("name") == name) & (F.col("version") == version)
        if table.filter(here).head():
            self.store.commit(prompts=store.update(table, here, {"user_template": F.lit(template), "updated_at": F.current_timestamp()}))
        else:
            row = self._row(name=name, version=version, strategy=strategy, user_template=template, system_prompt="", is_active=False)
            self.store.insert("prompts", row, ["name"])

    def activate_prompt(self, key: int) -> None:
        table = self.store.table("prompts")
        self.store.commit(prompts=store.activate(table, "strategy", "id", table.filter(F.col("id") == key)))

    # providers

    def use_provider(self, mode: str, **settings: str) -> None:
        """Switch to the provider of a mode (``auto``: the first available one)."""
        self.provider = self.factory.create(mode, settings)

    def stream(self, prompt: str, system: str = "") -> Iterator[str]:
        """Parts of an answer as they come."""
        return self.provider.stream(prompt, system)

    # projects

    def create_project(self, name: str, description: str = "") -> int:
        return self.store.insert("projects", self._row(name=name, description=description), ["name"])[0]

    def list_projects(self) -> DataFrame:
        return self.store.table("projects").orderBy(F.desc("updated_at"), F.desc("id"))

    def update_project(self, key: int, **patch) -> None:
        here = F.col("id") == key
        values = {k: F.lit(v) for k, v in patch.items() if v is not None}
        self.store.change(lambda: {"projects": store.update(self.store.table("projects"), here, values | {"updated_at": F.current_timestamp()})})

    def delete_project(self, key: int) -> None:
        self.store.delete("projects", key)

    def save_workspace(self, project_id: int, **values: str) -> None:
        old = self.store.table("project_workspace")
        high = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        row = self._row(project_id=project_id, **values)
        for f in old.schema.fields:
            if f.name not in row.columns:
                row = row.withColumn(f.name, F.current_timestamp() if f.name == "updated_at" else F.lit(high + 1 if f.name == "id" else None).cast(f.dataType))
        new = row.select(*(F.col(f.name).cast(f.dataType) for f in old.schema.fields))
        self.store.commit(project_workspace=store.upsert(old, new, ["project_id"]))

    def link_search(self, project_id: int, search_id: int) -> None:
        old = self.store.table("project_searches")
        if not old.filter((F.col("project_id") == project_id) & (F.col("search_id") == search_id)).head():
            self.store.insert("project_searches", self._row(project_id=project_id, search_id=search_id), ["project_id"])

    # searches and analyses

    def start_search(self, query: str, strategy: str = "prior_art") -> int:
        return self.store.insert("search_history", self._row(query=query, strategy=strategy, status="running"), ["query"])[0]

    def finish_search(self, key: int, hits: DataFrame, execution_ms: int = 0) -> None:
        """Store the first fifty candidates of a search (the first of each number) and its end."""
        hits = candidates.first_per_key(hits, F.col("patentNumber"), "rank")
        rows = hits.filter(F.col("rank") <= search.STORED).select(
            F.lit(key).cast("long").alias("search_id"), F.col("patentNumber").alias("patent_number"), "title", "abstract", "source", "url",
            F.lit(None).cast("boolean").alias("url_valid"), "bm25_score", "vector_score", "rrf_score", F.col("rank").cast("int").alias("stage1_rank"),
        )
        rows = staging.stage(rows.withColumn("doc", F.to_json(F.struct("patent_number", "title", "abstract"))))
        if rows.head():
            self.store.insert("search_candidates", rows, ["stage1_rank"])
        done = {"status": F.lit("done"), "results_count": F.lit(rows.count()), "execution_ms": F.lit(execution_ms).cast("long")}
        self.store.commit(search_history=store.update(self.store.table("search_history"), F.col("id") == key, done))

    def run_search(
        self, query: search.Query, wanted: list[str], template: str = "standard", folder: str | None = None, key: int | None = None, tell=lambda phase, percent, rows: None, make=None, api_keys: dict[str, str] | None = None
    ) -> tuple[int, run.Result]:
        """A search over registered sources by a template, and its stored results: (search id, result).

        ``folder`` holds the phases; a cancelled search goes on when it is run again with its ``key`` and folder. ``make`` gives the provider
        that judges documents, in each task anew; without it, scores come from the ranks.
        """
        key = self.start_search(query.text, template) if key is None else key
        stop = self.running[key] = workspace.Cancel(self.spark, f"search {key}")
        folder = folder or f"{self.store.path}/_runs/{key}"
        settings = run.settings_of(template, self.get_settings())
        allowed = self.allowed or list(self.registry.sources)
        try:
            one = run.SearchRun.over_sources(self.spark, folder, query, self.registry, wanted, allowed, api_keys, make=make, settings=settings, cancel=stop, tell=tell)
            result = one.run()
        finally:
            self.running.pop(key, None)
        run.save(self.store, key, result)
        return key, result

    def cancel_search(self, key: int) -> bool:
        """Stop a running search; whether there was one."""
        stop = self.running.pop(key, None)
        if stop is not None:
            stop.cancel()
        return stop is not None

    def recent_searches(self, n: int = 20) -> DataFrame:
        return store.recent(self.store.table("search_history"), n)

    def analyse(self, search_id: int, strategy: str, **variables: str) -> dict:
        """Fill the active prompt of a strategy, ask the provider, store the answer."""
        prompt = providers.active_prompt(self.store.table("prompts"), strategy).first()
        text = prompt.user_template if prompt else "{{claims}}"
        for name, value in variables.items():
            text = text.replace("{{" + name + "}}", value or "")
        reply = providers.with_retry(lambda: self.provider.generate(text, prompt.system_prompt if prompt else ""))
        self.store.insert(
            "analysis_results",
            self._row(search_id=search_id, strategy=strategy, prompt=text, result=reply.content, input_tokens=reply.input_tokens, output_tokens=reply.output_tokens),
            ["strategy"],
        )
        return json.loads(reply.content)

    def token_stats(self) -> DataFrame:
        return store.token_totals(self.store.table("analysis_results"))

    # documents and claims

    def parse_claim(self, text: str):
        row = self.spark.range(1).select(claims.elements(F.lit(text)).alias("e"), claims.broad_terms(F.lit(text)).alias("b"), claims.technical_field(F.lit(text)).alias("f")).first()
        return {"elements": row.e, "broadTerms": row.b, "technicalField": row.f}

    def chunk_text(self, text: str):
        return self.spark.range(1).select(chunking.overlaps(chunking.chunk_array(F.lit(text), F.lit(0))).alias("c")).first().c

    def load_documents(self, path: str) -> DataFrame:
        """(file, text, page_count) of a folder of extracted documents, a form feed between pages."""
        return sources.read_documents(self.spark, path)

    def best_chunks(self, chunk_table: DataFrame, query: str, types: list[str], top_k: int = 5) -> DataFrame:
        """The chunks of some section types that answer a query best."""
        return search.retrieve_from_sections(chunk_table, query, types, top_k)

    def export(self, project_id: int) -> str:
        """A project's bundle as JSON."""
        links = self.store.table("project_searches").filter(F.col("project_id") == project_id)
        found = self.store.table("search_history").join(links.select("project_id", F.col("search_id").alias("id")), "id")
        project = self.store.table("projects").filter(F.col("id") == project_id)
        return report.bundle(project, self.store.table("project_workspace"), found, self.store.table("analysis_results")).first().json

    def import_bundle(self, path: str) -> int:
        """Add an exported project under new ids, its searches and their analyses with it; gives the project's id."""
        held = bundles.read(self.spark, path)
        names = list(bundles.TABLES)
        made: dict[str, int] = {}

        def changes() -> dict[str, store.Append]:
            high = {n: self.store.table(n).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for n in names}
            made["projects"] = high["projects"] + 1
            return {n: self.store.appended(n, rows) for n, rows in bundles.renumbered(held, high).items()}

        self.store.change(changes)
        return made["projects"]

    def needed_migrations(self, known: list[int]) -> list[int]:
        return workspace.migrated(self.store.table("_schema_versions"), known)
