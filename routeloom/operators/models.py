"""Language models as policies: prompts, calls from the executors, and a record of every decision."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TARGET_PREFIX, parse_choice, render_candidate
from ..storage import cut
from .frontier import render_view, select_view

MAX_FAILURES = 5
SCHEMA = {"type": "object", "properties": {"choice": {"type": "integer"}}, "required": ["choice"], "additionalProperties": False}


@dataclass
class Completion:
    text: str
    refused: bool = False
    input_tokens: int = 0
    output_tokens: int = 0
    cached_tokens: int = 0


class Backend(Protocol):
    """Answers a prompt; raises ``ConnectionError`` for a failed call."""

    def complete(self, system: str, prompt: str, schema: dict | None = None) -> Completion: ...


@dataclass
class ScriptedBackend:
    """A stand-in: answers in turn, and keeps the prompts it got."""

    answers: list[str | Completion | Exception]
    prompts: list[str] = field(default_factory=list)

    def complete(self, system: str, prompt: str, schema: dict | None = None) -> Completion:
        self.prompts.append(prompt)
        answer = self.answers[(len(self.prompts) - 1) % len(self.answers)]
        if isinstance(answer, Exception):
            raise answer
        return answer if isinstance(answer, Completion) else Completion(answer)


@dataclass
class HTTPBackend:
    """A server that speaks the chat completions protocol; one client for each Python worker.

    A server that answers 400 to a request with a schema is asked without one from then on.
    The key is read from an environment variable of the executors, so it is not in the plan.
    """

    url: str
    model: str
    key_variable: str = "ROUTELOOM_MODEL_KEY"
    max_tokens: int = 512
    temperature: float = 0.0
    timeout: float = 120.0
    plain: bool = False

    def complete(self, system: str, prompt: str, schema: dict | None = None) -> Completion:
        body = {
            "model": self.model, "max_tokens": self.max_tokens, "temperature": self.temperature,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}],
        }
        if schema is not None and not self.plain:
            shaped = body | {"response_format": {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}}
            answer = self.post(shaped, or_none=True)
            self.plain = answer is None
        else:
            answer = None
        if answer is None:
            answer = self.post(body)
        try:
            choice, used = answer["choices"][0], answer.get("usage") or {}
            message = choice["message"]
        except (KeyError, IndexError, TypeError) as error:
            raise ConnectionError("an answer without a choice") from error
        refused = bool(message.get("refusal")) or choice.get("finish_reason") == "content_filter"
        cached = (used.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
        return Completion(message.get("content") or "", refused, used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0, cached)

    def post(self, body: dict, or_none: bool = False):
        """The decoded answer; with ``or_none`` None for a request that the server finds malformed."""
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as got:
                return json.load(got)
        except urllib.error.HTTPError as error:
            if error.code == 400 and or_none:
                return None
            raise ConnectionError(f"status {error.code}") from error
        except (OSError, ValueError) as error:
            raise ConnectionError(str(error)) from error


def make_backend(kind: str, **settings) -> Backend:
    kinds = {"http": HTTPBackend, "scripted": ScriptedBackend}
    if kind not in kinds:
        raise ValueError(f"backend must be one of {sorted(kinds)}, got {kind!r}")
    return kinds[kind](**settings)


@dataclass(frozen=True)
class ToolSurface:
    """Which columns a candidate's line shows."""

    closeness: bool = False
    ec: bool = False
    plausibility: bool = False

    @property
    def name(self) -> str:
        shown = [n for n, on in (("ecfp", self.closeness), ("ec", self.ec), ("enz", self.plausibility)) if on]
        return "+".join(shown) or "none"


SECTIONS = {
    "base": "You steer a route search. Of the molecules listed, pick the one to open next. Reply in JSON, as {\"choice\": index, \"reason\": text}.",
    "closeness": "closest_chassis: how similar the candidate is to the nearest available molecule, from 0 to 1.",
    "ec": "EC: the enzyme classes of the reactions that lead to the candidate.",
    "plausibility": "enzymatic: the mean score of a step on the best way to the candidate; in brackets the product over that way and its length.",
}


def system_prompt(tools: ToolSurface, explain: bool = True) -> str:
    """Sections only for columns that are shown; none of them without ``explain``."""
    parts = [SECTIONS["base"]] + [SECTIONS[n] for n in ("closeness", "ec", "plausibility") if explain and getattr(tools, n)]
    return "\n\n".join(parts)


def user_prompt(target: Column, n_molecules: Column, n_reactions: Column, n_solved: Column, view: Column) -> Column:
    """The prompt of a decision, in search and replay alike; its first line is what readers of pairs look for."""
    sizes = F.format_string("\nGraph: %d molecules (%d of them solved), %d reactions.\n\n", n_molecules, n_solved, n_reactions)
    return F.concat(F.lit(TARGET_PREFIX), target, sizes, view, F.lit("\n\nIndex of the next molecule to open?"))


def candidate_line(frontier: DataFrame, tools: ToolSurface) -> Column:
    """A candidate's line from ``place``, ``mol``, ``depth`` and the shown columns that the frontier has."""
    has = lambda on, c: F.col(c) if on and c in frontier.columns else None
    scored = tools.plausibility and {"per_step", "cumulative", "edges"} <= set(frontier.columns)
    route = {k: F.col(c) for k, c in (("per_step", "per_step"), ("route", "cumulative"), ("edges", "edges"))} if scored else {}
    return render_candidate(
        F.col("place") - 1, F.col("mol").cast("string"), F.col("depth"), ec=has(tools.ec, "ec"), closeness=has(tools.closeness, "closeness"), nearest=has(tools.closeness, "nearest"), **route
    )


def prompts_of(frontier: DataFrame, view: DataFrame, order: str, tools: ToolSurface) -> DataFrame:
    """(run, prompt, n_candidates, n_frontier) of each run's view of its frontier."""
    sizes = frontier.groupBy("run").agg(*(F.max(c).alias(c) for c in ("target", "n_molecules", "n_reactions", "n_solved")), F.count("*").alias("n_total"))
    shown = view.join(frontier, ["run", "id"]).join(sizes.select("run", "n_total"), "run")
    texts = render_view(shown.withColumn("line", candidate_line(frontier, tools)), order)
    counts = view.groupBy("run").agg(F.count("*").cast("int").alias("n_candidates"))
    prompt = user_prompt(F.col("target").cast("string"), F.col("n_molecules"), F.col("n_reactions"), F.col("n_solved"), F.col("text"))
    return texts.join(sizes, "run").join(counts, "run").select("run", prompt.alias("prompt"), "n_candidates", F.col("n_total").alias("n_frontier"))


RAW = "text string, refused boolean, input_tokens long, output_tokens long, cached_tokens long, error string, elapsed_s double, called boolean"


def ask(prompts: DataFrame, backend: Backend, system: str) -> DataFrame:
    """The record of each decision of (run, prompt, n_candidates): choice, fallback, reason, tokens, seconds, whether a call was made.

    One candidate needs no call (skipped_single). A failed, refused, unreadable or out-of-range
    answer takes the first candidate and says why; five failed calls in a row end the task.
    The executors bring the answers, column functions read them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures = 0
        for batch in batches:
            out = []
            for r in batch.itertuples():
                row, began = asdict(Completion("")) | {"error": None, "called": r.n_candidates > 1}, time.perf_counter()
                if row["called"]:
                    try:
                        row |= asdict(backend.complete(system, r.prompt, SCHEMA))
                        failures = 0
                    except ConnectionError as error:
                        failures += 1
                        if failures >= MAX_FAILURES:
                            raise RuntimeError(f"{MAX_FAILURES} calls failed in a row") from error
                        row["error"] = type(error).__name__
                out.append(row | {"elapsed_s": time.perf_counter() - began})
            answers = pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")])
            yield pd.concat([batch.reset_index(drop=True), answers], axis=1)

    kinds = ", ".join(f"{c} {prompts.schema[c].dataType.simpleString()}" for c in ("run", "prompt", "n_candidates"))
    raw = prompts.select("run", "prompt", "n_candidates").mapInPandas(run, f"{kinds}, {RAW}").withColumn("read", parse_choice(F.col("text")))
    choice = F.col("read.choice")
    fallback = (
        F.when(~F.col("called"), "skipped_single").when(F.col("error").isNotNull(), F.concat(F.lit("api_error:"), "error")).when(F.col("refused"), "refusal")
        .when(choice.isNull(), "unparseable").when(~choice.between(0, F.col("n_candidates") - 1), F.concat(F.lit("out_of_range:"), choice.cast("string")))
    )
    out = raw.withColumn("fallback", fallback).withColumn("choice", F.when(fallback.isNull(), choice).otherwise(0)).withColumn("reason", F.col("read.reason"))
    return out.select("run", "n_candidates", "choice", "fallback", "reason", "called", "input_tokens", "output_tokens", "cached_tokens", "elapsed_s", "prompt")


def is_failure(fallback: Column) -> Column:
    """Fallbacks that are the model's, not a decision that needed no call."""
    return fallback.isNotNull() & (fallback != "skipped_single")


class ModelPolicy:
    """A model as a policy: it sees a view of each frontier and answers with a place in it.

    Calls are made in the executors, in batches of runs; ``calls`` keeps their records, a table
    for each step. The lines show what the tool surface allows.
    """

    needs_graph = True

    def __init__(self, backend: Backend, tools: ToolSurface = ToolSurface(), top_k: int = 20, order: str = "stratified", seed: int = 0):
        self.backend, self.tools, self.top_k, self.order, self.seed = backend, tools, top_k, order, seed
        self.calls: list[DataFrame] = []

    def __call__(self, frontier: DataFrame) -> DataFrame:
        view = cut(select_view(frontier, self.order, self.top_k, self.seed), "view")
        prompts = prompts_of(frontier, view, self.order, self.tools)
        record = cut(ask(prompts, self.backend, system_prompt(self.tools)).withColumn("step", F.lit(len(self.calls))), "calls")
        self.calls.append(record)
        chosen = record.select("run", (F.col("choice") + 1).alias("place"))
        return view.join(chosen, ["run", "place"]).join(frontier.select("run", "id", "mol"), ["run", "id"]).select("run", "mol")

    def call_log(self) -> DataFrame:
        """All records; ``llm_calls``, tokens and failures of a run table are sums over it."""
        out = self.calls[0]
        for more in self.calls[1:]:
            out = out.unionByName(more)
        return out
