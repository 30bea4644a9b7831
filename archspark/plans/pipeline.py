"""Indexing of a code base and requests against it: radius, retrieval, context, reasoning, audit."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators import chunk, context, graph, metrics, vectors
from archspark.operators.audit import AuditLog
from archspark.session import durable


@dataclass
class ReasoningResult:
    """What a reasoner gave, or why it failed."""

    text: str | None
    model: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    duration_ms: int | None = None
    error: str | None = None


class Reasoner(Protocol):
    """A language model behind a protocol; errors are returned, not raised. Hosted ones are up to the user."""

    model: str

    def reason(self, system: str, prompt: str) -> ReasoningResult: ...


class DryRunReasoner:
    """Answers with the size of what it was asked."""

    model = "dry-run"

    def reason(self, system: str, prompt: str) -> ReasoningResult:
        chars = len(system) + len(prompt)
        return ReasoningResult(f"dry run: {chars} characters, about {chars // 4} tokens", self.model, chars // 4, 0, 0)


def default_model() -> str:
    return DryRunReasoner.model


@dataclass
class IndexReport:
    """What was indexed; ``unreadable`` holds the paths of all files without content (a written table), counted exactly."""

    chunks: int
    files: int
    unreadable: DataFrame
    unreadable_count: int
    embedder: str

    def unreadable_line(self, shown: int = 3) -> str:
        """The count, with the first paths as a preview."""
        first = [str(r["path"]) for r in self.unreadable.orderBy("path").limit(shown).collect()] if self.unreadable_count else []
        more = self.unreadable_count - len(first)
        return f"{self.unreadable_count} unreadable" + (f": {', '.join(first)}" if first else "") + (f" (and {more} more)" if more else "")


def index_snapshot(nodes: DataFrame, files: DataFrame, module_metrics: DataFrame, store: vectors.VectorStore, embedder: vectors.Embedder, config: chunk.ChunkingConfig = chunk.ChunkingConfig()) -> IndexReport:
    """Chunk, embed and store every declaration as one DataFrame plan; the points of these paths are replaced."""
    if (embedder.name, embedder.dimensions) != (store.embedder_name, store.dimensions):
        raise ValueError("store and embedder do not match")
    found = chunk.embedding_text(chunk.chunk(nodes, files, config))
    points = vectors.point_ids(vectors.embed(vectors.with_metrics(found, module_metrics), embedder)).drop("embedding_text")
    store.replace_paths(points)
    stored = store.points().join(nodes.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("path").alias("p")).first()
    lost = durable(chunk.unreadable(nodes, files))
    return IndexReport(stored["n"], stored["p"], lost, lost.count(), embedder.name)


def search_code(store: vectors.VectorStore, embedder: vectors.Embedder, query: str, limit: int = 10, paths: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    return vectors.citation(store.search(embedder.embed([query])[0], limit=limit, paths=paths, min_score=min_score))


@dataclass
class RefactorOutcome:
    target: str
    dependents: list[str]
    dependencies: list[str]
    truncated: bool
    context: context.AssembledContext
    reasoning: ReasoningResult
    audit_id: int | None = None
    notes: list[str] = field(default_factory=list)

    def summary_lines(self) -> list[str]:
        r = self.reasoning
        return [
            f"target: {self.target}",
            f"radius: {len(self.dependents)} dependents, {len(self.dependencies)} dependencies{' (cut)' if self.truncated else ''}",
            f"context: {len(self.context.included)} chunks, {self.context.total_chars} characters, {len(self.context.excluded)} left out",
            f"model: {r.model}" + (f", failed: {r.error}" if r.error else ""),
        ]


def run_refactor(
    vertices: DataFrame, edges: DataFrame, store: vectors.VectorStore, embedder: vectors.Embedder, target: str, request: str,
    reasoner: Reasoner | None = None, audit: AuditLog | None = None, depth: int = 2, limit: int = 15, budget: context.ContextBudget = context.ContextBudget(),
) -> RefactorOutcome:
    """One request: an unknown target raises KeyError before anything is searched; the audit record is always written."""
    reasoner = reasoner or DryRunReasoner()
    radius = graph.blast_radius(vertices, edges, target, depth).orderBy("direction", "rank").collect()
    side = lambda name: [r["path"] for r in radius if r["direction"] == name]
    dependents, dependencies = side("dependents"), side("dependencies")
    totals = {r["direction"]: r["total"] for r in radius}
    truncated = sum(totals.values()) > len(radius)
    own = metrics.one_module(vertices, edges, target).first().asDict()
    paths = list(dict.fromkeys([target, *dependents, *dependencies]))
    found = search_code(store, embedder, request, limit, paths)
    assembled = context.assemble(request, target, own, dependents, dependencies, found, budget)
    began = time.time()
    try:
        result = reasoner.reason(context.SYSTEM_PROMPT, assembled.prompt)
    except Exception as e:
        result = ReasoningResult(None, reasoner.model, error=f"{type(e).__name__}: {e}")
    if result.duration_ms is None:
        result.duration_ms = int(1000 * (time.time() - began))
    outcome = RefactorOutcome(target, dependents, dependencies, truncated, assembled, result)
    if audit:
        outcome.audit_id = audit.record(
            target=target, request=request, model=result.model, dependents=dependents, dependencies=dependencies, radius_depth=depth, radius_truncated=truncated,
            target_afferent=int(own["ca"]), target_efferent=int(own["ce"]), target_instability=float(own["instability"]), retrieved_chunks=assembled.included, excluded_chunks=assembled.excluded,
            prompt=assembled.prompt, prompt_chars=len(assembled.prompt), response=result.text, input_tokens=result.input_tokens, output_tokens=result.output_tokens, duration_ms=result.duration_ms, error=result.error,
        )
    return outcome
