"""Model providers behind batch functions. Remote models are plug-ins; the stubs are deterministic and need no network.

A text model is any object with ``complete(prompts) -> answers``, an embedding model any with ``embed(texts) ->
vectors``, both over lists. They run inside Arrow batches on the executors; texts are made distinct first, so a text is
sent once.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions import text as T


class TextModel(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class EmbeddingModel(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass
class StubText:
    """Names a prompt by its first words."""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [f"Name: {' '.join(p.split()[:4])}\nDescription: {' '.join(p.split()[:12])}" for p in prompts]


@dataclass
class StubOrganiser:
    """Answers the prompts of ``naming.facet_hierarchy``: the first clusters name the categories, which take clusters in turn."""

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    @staticmethod
    def _answer(prompt: str) -> str:
        task, _, rest = prompt.partition("\n")
        listed = [line.partition(": ")[2].partition(" - ") for line in rest.partition("\n\n")[0].splitlines()]
        if task.startswith("Name"):
            return "\n".join(f"Name: {n}\nDescription: {d}" for n, _, d in listed[: int(task.split()[1])])
        if task.startswith("Assign"):
            categories = len(rest.partition("\n\n")[2].splitlines())
            return "\n".join(f"{i + 1} -> {chr(65 + i % categories)}" for i in range(len(listed)))
        name = task.partition(": ")[2]
        return f"Name: {name} ({len(listed)})\nDescription: {name} and others"


@dataclass
class StubEmbedding:
    """A hashed bag of words of unit length."""

    dim: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h & 0x80000000 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size if size else 0.0 for x in v])
        return out


REGISTRY: dict[str, Callable[..., object]] = {"stub": StubText, "stub-embedding": StubEmbedding}


def create(name: str, **options) -> object:
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def complete(df: DataFrame, prompt: str, model: TextModel, out: str = "answer") -> DataFrame:
    """Adds the answers; each distinct prompt is asked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column("_p").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("_p"), pa.array(model.complete(asked), pa.string())], ["_p", out])

    answers = df.select(F.col(prompt).alias("_p")).where("_p is not null").distinct().mapInArrow(run, f"_p string, {out} string")
    return df.join(answers, F.col(prompt) == F.col("_p"), "left").drop("_p")


def embed(df: DataFrame, text: str, model: EmbeddingModel, cache: DataFrame | None = None, name: str = "stub") -> DataFrame:
    """Adds ``v``. ``cache`` has (key, v) with key the hash of text and model name; only misses are computed."""
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("|", F.col(text), F.lit(name)), 256))
    wanted = keyed.select("_key", F.col(text).alias("_t")).dropDuplicates(["_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(model.embed(b.column("_t").to_pylist()), pa.list_(pa.float64()))], ["_key", "v"])

    misses = wanted if cache is None else wanted.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    made = misses.mapInArrow(run, "_key string, v array<double>")
    known = made if cache is None else made.unionByName(cache.select(F.col("key").alias("_key"), "v"))
    return keyed.join(known, "_key", "left").drop("_key")


def heuristic_facets(text: Column) -> Column:
    """What stands in for a model's facets: category, sentiment and length."""
    mood = T.sentiment_label(T.sentiment_by_count(text), 0.0)
    pairs = (("category", T.category_scored(text)), ("sentiment", mood), ("length", F.when(F.length(text) > 200, "long").otherwise("short")), ("method", F.lit("heuristic")))
    return F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value"), F.lit(0.5).alias("confidence")) for k, v in pairs])


def facet_lists(answer: Column, n: int) -> Column:
    """The JSON array between the first [ and the last ], cut or filled with empty lists to n."""
    body = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    found = F.coalesce(F.from_json(body, "array<array<struct<name:string,value:string,confidence:double>>>"), F.array().cast("array<array<struct<name:string,value:string,confidence:double>>>"))
    empty = F.array_repeat(F.array().cast("array<struct<name:string,value:string,confidence:double>>"), n)
    return F.slice(F.concat(found, empty), 1, n)


def facet_lines(answer: Column, most: int = 5) -> Column:
    """Blocks of Name, Value and Confidence lines; without a confidence 0.8, with a bad one 0.5."""
    blocks = F.filter(F.split(answer, r"(?m)^(?=\s*Name:)"), lambda b: F.rlike(b, F.lit(r"Name:\s*\S")))

    def facet(b: Column) -> Column:
        given = T.strip(F.regexp_extract(b, r"Confidence:([^\n]*)", 1))
        confidence = F.when(given == "", 0.8).otherwise(F.coalesce(given.try_cast("double"), F.lit(0.5)))
        return F.struct(T.strip(F.regexp_extract(b, r"Name:([^\n]*)", 1)).alias("name"), T.strip(F.regexp_extract(b, r"Value:([^\n]*)", 1)).alias("value"), confidence.alias("confidence"))

    return F.slice(F.transform(blocks, facet), 1, most)


def facet_pairs(answer: Column, names: Sequence[str] = ("sentiment", "category", "topic", "intent", "language")) -> Column:
    """key=value pairs of known facets in a free answer."""
    low = F.lower(answer)
    found = [(n, F.regexp_extract(low, rf"{n}\s*[=:]\s*([a-z_]+)", 1)) for n in names]
    return F.array_compact(F.array(*[F.when(v != "", F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(0.6).alias("confidence"))) for n, v in found]))


#: Facets asked of a conversation, as (name, question, prefill, criteria for names, least, most).
MAIN_FACETS = (
    ("Request", "What is the user's overall request for the assistant?", "The user's overall request for the assistant is to", None, None, None),
    ("Language", "What are the main languages of the conversation?", "", None, None, None),
    ("Task", "What task is the model being asked to perform in this conversation?", "The task is to", None, None, None),
    ("Concerning", "On a scale of 1 to 5, how concerning or potentially harmful is this conversation?", "", None, 1, 5),
)


def facet_prompt(text: Column, question: str, prefill: str) -> Column:
    return F.concat(F.lit("Conversation:\n"), text, F.lit(f"\n\nQuestion: {question}\nAnswer: {prefill}"))


def fill(template: str, values: dict[str, str]) -> str:
    """A template with all its {names} given; raises with the names that are missing."""
    import string

    needed = {n for _, n, _, _ in string.Formatter().parse(template) if n}
    if missing := sorted(needed - values.keys()):
        raise ValueError(f"missing: {', '.join(missing)}")
    return template.format(**values)


def dump(templates: list[dict]) -> str:
    return json.dumps(templates, sort_keys=True)


def merge(own: list[dict], other: str) -> list[dict]:
    """Templates by id; those already there stay."""
    known = {t["id"] for t in own}
    return own + [t for t in json.loads(other) if t["id"] not in known]


class Unavailable(RuntimeError):
    """A model that cannot answer now."""


@dataclass
class Recovering:
    """A text model with retries, then the next of its fallbacks; a model that failed ``failures`` times in a row is passed over.

    ``waits`` has the seconds before each retry. Used on executors, so each Python worker counts for itself.
    """

    models: Sequence[TextModel]
    waits: Sequence[float] = (0.0, 0.0)
    failures: int = 5

    def __post_init__(self):
        self.failed = [0] * len(self.models)

    def complete(self, prompts: Sequence[str]) -> list[str]:
        import time

        last: Exception | None = None
        for i, model in enumerate(self.models):
            if self.failed[i] >= self.failures and i + 1 < len(self.models):
                continue
            for wait in (0.0, *self.waits):
                time.sleep(wait)
                try:
                    answers = model.complete(prompts)
                    self.failed[i] = 0
                    return answers
                except Unavailable as e:
                    last, self.failed[i] = e, self.failed[i] + 1
        raise Unavailable("no model answered") from last


def choose_version(rates: dict[str, float], draw: float, other: str, epsilon: float = 0.1) -> str:
    """The version of best success rate, or ``other`` for a share ``epsilon`` of draws from 0 to 1; of equals the least name."""
    return other if draw < epsilon or not rates else min(rates, key=lambda v: (-rates[v], v))


def estimates(provider: Column, model: Column, conversations: Column) -> tuple[Column, Column]:
    """(seconds, dollars) by fixed rates for each conversation."""
    seconds = F.when(provider == "openai", 0.5).when(provider == "ollama", 1.0).when(provider == "vllm", 0.3).otherwise(0.75)
    dollars = F.when(model == "gpt-4o", 0.01).when(model == "gpt-4o-mini", 0.002).when(model == "gpt-3.5-turbo", 0.001)
    return seconds * conversations, F.when(provider == "openai", F.coalesce(dollars, F.lit(0.0))).otherwise(0.0) * conversations
