"""Language models behind a small interface, with a stub that always answers alike, and prompts as data."""

from __future__ import annotations

import hashlib
import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A longer prompt is refused.
LONGEST_PROMPT = 120_000


@dataclass(frozen=True)
class Reply:
    content: str
    input_tokens: int
    output_tokens: int


class ModelError(Exception):
    """``wait_s``: how long the model asks to be left alone (its retry-after), if it does."""

    def __init__(self, message: str, status: int | None = None, wait_s: float | None = None):
        super().__init__(message)
        self.retryable = status in (429, 529) or (status or 0) >= 500
        self.wait_s = wait_s

    def __reduce__(self):
        return _model_error, (str(self), self.retryable, self.wait_s)


def _model_error(message: str, retryable: bool, wait_s: float | None) -> ModelError:
    return ModelError(message, 529 if retryable else None, wait_s)


class Provider(Protocol):
    def generate(self, prompt: str, system: str = "") -> Reply: ...

    def stream(self, prompt: str, system: str = "") -> Iterator[str]: ...

    def is_available(self) -> bool: ...


class StubProvider:
    """Answers with JSON that depends on the prompt alone."""

    def generate(self, prompt: str, system: str = "") -> Reply:
        if len(prompt) > LONGEST_PROMPT:
            raise ModelError("prompt too long")
        mark = hashlib.sha256((system + "\n" + prompt).encode()).hexdigest()
        text = json.dumps({"reasoning": f"stub {mark[:12]}", "risk_level": ("LOW", "MEDIUM", "HIGH")[int(mark, 16) % 3]})
        return Reply(text, len(prompt) // 4, len(text) // 4)

    def stream(self, prompt: str, system: str = "") -> Iterator[str]:
        text = self.generate(prompt, system).content
        for k in range(0, len(text), 16):
            yield text[k : k + 16]

    def is_available(self) -> bool:
        return True


class ProviderFactory:
    """Providers by mode. ``auto`` is the first registered one that has what it needs and says that it is available; a provider is made once for its settings."""

    def __init__(self):
        self.makers: dict[str, tuple[Callable[[dict], Provider], tuple[str, ...]]] = {}
        self._made: dict[tuple, Provider] = {}
        self.register("stub", lambda settings: StubProvider())

    def register(self, mode: str, make: Callable[[dict], Provider], needs: tuple[str, ...] = ()) -> None:
        """``needs`` names settings that must be filled."""
        self.makers.pop(mode, None)
        self.makers[mode] = (make, needs)

    def modes(self) -> list[str]:
        """Modes in the order in which ``auto`` tries them; the stub comes last."""
        return [m for m in self.makers if m != "stub"] + ["stub"]

    def resolve(self, mode: str, settings: dict | None = None) -> Provider:
        """A new provider. A mode that is not there or lacks a setting is an error that is not worth a retry."""
        settings = settings or {}
        if mode == "auto":
            for name in self.modes():
                if not self._lacks(name, settings) and (provider := self.makers[name][0](settings)).is_available():
                    return provider
            raise ModelError("no provider is available")
        if mode not in self.makers:
            raise ModelError(f"no provider for mode {mode}")
        if lacking := self._lacks(mode, settings):
            raise ModelError(f"mode {mode} needs {', '.join(lacking)}")
        return self.makers[mode][0](settings)

    def _lacks(self, mode: str, settings: dict) -> list[str]:
        return [n for n in self.makers[mode][1] if not str(settings.get(n) or "").strip()]

    def create(self, mode: str, settings: dict | None = None) -> Provider:
        """The provider of these settings, made at the first call."""
        key = (mode, *sorted((settings or {}).items()))
        if key not in self._made:
            self._made[key] = self.resolve(mode, settings)
        return self._made[key]

    def invalidate(self) -> None:
        """Settings have changed: the next calls make providers anew."""
        self._made.clear()


def with_retry(call: Callable[[], Reply], attempts: int = 3, base_s: float = 1.0, most_s: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Reply:
    for n in range(1, attempts + 1):
        try:
            return call()
        except ModelError as error:
            if not error.retryable or n == attempts:
                raise
            sleep(min(base_s * 2 ** (n - 1) if error.wait_s is None else error.wait_s, most_s))
    raise AssertionError("attempts must be positive")


def in_window(calls: Iterator, call: Callable, width: int) -> Iterator:
    """``call`` of each of ``calls``, ``width`` at a time, in their order: the next one starts when the oldest has ended."""
    if width <= 1:
        yield from map(call, calls)
        return
    with ThreadPoolExecutor(width) as pool:
        waiting: deque[Future] = deque()
        for one in calls:
            waiting.append(pool.submit(call, one))
            if len(waiting) >= width:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def generate_all(df: DataFrame, make: Callable[[], Provider], prompt: str = "prompt", system: str = "system", width: int = 1) -> DataFrame:
    """``df`` with content, input_tokens, output_tokens and error for each prompt.

    A provider is made once a task and serves ``width`` calls at a time; replies keep the order of the rows, what fails after its retries is a
    row with its error.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        provider = make()

        def ask(one: tuple) -> tuple:
            try:
                r = with_retry(lambda: provider.generate(one[0] or "", one[1] or ""))
                return r.content, r.input_tokens, r.output_tokens, None
            except ModelError as error:
                return None, 0, 0, str(error)

        for batch in batches:
            out = list(in_window(zip(batch[prompt], batch[system], strict=True), ask, width))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield batch.assign(content=list(cols[0]), input_tokens=list(cols[1]), output_tokens=list(cols[2]), error=list(cols[3]))

    return df.mapInPandas(run, f"{fields}, content string, input_tokens long, output_tokens long, error string")


def total_tokens(usage) -> F.Column:
    """Input and output tokens of a reply's usage (struct<input_tokens, output_tokens>); missing ones count as 0."""
    return F.coalesce(usage["input_tokens"].cast("long"), F.lit(0)) + F.coalesce(usage["output_tokens"].cast("long"), F.lit(0))


def text_of_blocks(blocks) -> F.Column:
    """The text blocks of a reply (array<struct<type, text>>) joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


#: Analyses that can be asked for: (name, strategy, what is asked).
PROMPTS = [
    ("novelty-default", "novelty", "Is every feature of {{claims}} disclosed by {{prior_art}}? Answer in JSON."),
    ("inventiveness-default", "inventiveness", "Would a skilled person arrive at {{claims}} from {{prior_art}}? Answer in JSON."),
    ("prior-art-default", "prior_art", "Which documents are closest to {{query}}? Answer in JSON."),
    ("claims-default", "claims_analysis", "Break {{claims}} into elements. Answer in JSON."),
]
#: Ways to search: (id, sources, candidates a source, reranking).
SEARCH_TEMPLATES = [("quick", 25, False), ("standard", 25, True), ("broad", 50, True), ("claims", 25, True), ("local", 100, False)]


def search_template(key: str) -> tuple | None:
    """The way to search of this id, or None."""
    return next((t for t in SEARCH_TEMPLATES if t[0] == key), None)


def prompt_count(prompts: DataFrame) -> DataFrame:
    return prompts.agg(F.count("*").alias("count"))


def default_prompts(spark) -> DataFrame:
    return spark.createDataFrame([(n, s, "", t, "1.0.0", True) for n, s, t in PROMPTS], "name string, strategy string, system_prompt string, user_template string, version string, is_active boolean")


def missing_prompts(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Built-in prompts that the store lacks, by name and version."""
    return defaults.join(stored.select("name", "version"), ["name", "version"], "left_anti")


def active_prompt(prompts: DataFrame, strategy: str) -> DataFrame:
    """The active prompt of a strategy, else its first, else none."""
    return prompts.filter(F.col("strategy") == strategy).orderBy(F.desc("is_active"), "id").limit(1)


def prompts_of(prompts: DataFrame, strategy: str | None = None) -> DataFrame:
    """Prompts by version, as text, descending."""
    picked = prompts if strategy is None else prompts.filter(F.col("strategy") == strategy)
    return picked.orderBy("strategy", F.desc("version"))


def prompt_variables(df: DataFrame) -> DataFrame:
    """Null inputs as empty text; the claims fill two variables."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select("*", blank("claims").alias("v_claims"), blank("claims").alias("v_claim_text"), blank("prior_art").alias("v_prior_art"), blank("query").alias("v_query"))
