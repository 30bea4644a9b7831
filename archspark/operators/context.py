"""Prompt context under a budget: ranked chunks are taken first-fit, what does not fit is skipped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ContextBudget:
    """Characters in all, characters of one chunk, and number of chunks."""

    max_total_chars: int = 120_000
    max_chunk_chars: int = 6_000
    max_chunks: int = 25

    def __post_init__(self) -> None:
        if self.max_chunk_chars > self.max_total_chars:
            raise ValueError("max_chunk_chars exceeds max_total_chars")


def first_fit(items: Column, budget: ContextBudget, used: int = 0) -> Column:
    """Fold over ``items`` (array of ``struct<id, size>`` in rank order) to ``struct<used, kept, dropped>``.

    An item counts with at most ``max_chunk_chars``; one that exceeds what is left is dropped and the next is tried.
    """
    start = F.struct(F.lit(used).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("dropped"))

    def step(acc: Column, x: Column) -> Column:
        size = F.least(x["size"].cast("bigint"), F.lit(budget.max_chunk_chars).cast("bigint"))
        fits = (F.size(acc["kept"]) < budget.max_chunks) & (acc["used"] + size <= budget.max_total_chars)
        one = F.array(x["id"].cast("string"))
        return F.struct(
            F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["dropped"]).otherwise(F.concat(acc["dropped"], one)).alias("dropped"),
        )

    return F.aggregate(items, start, step)


SYSTEM_PROMPT = (
    "You help to change a code base whose structure has been measured. Use the coupling numbers, the dependents and the "
    "retrieved declarations below. Name every file that must change, keep public behaviour, prefer small steps, and say "
    "so when the given code does not suffice to answer."
)
_CUT = "\n... (cut)"


@dataclass
class AssembledContext:
    """The prompt and what went into it."""

    prompt: str
    included: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    total_chars: int = 0
    budget_exhausted: bool = False


def format_metrics(ca: int, ce: int, instability: float) -> str:
    return f"Ca={ca} Ce={ce} I={instability:.2f}"


def assemble(request: str, target: str, metrics: dict, dependents: list[str], dependencies: list[str], results: DataFrame, budget: ContextBudget = ContextBudget()) -> AssembledContext:
    """Context of a request from at most ``limit`` ranked results (a few dozen rows, collected).

    A formatted chunk beyond ``max_chunk_chars`` is cut; one that finds no place, by characters or by number, is
    excluded and the budget counts as exhausted.
    """
    lines = [f"Target: {target}", "Coupling: " + format_metrics(metrics.get("ca", 0), metrics.get("ce", 0), metrics.get("instability", 0.0))]
    for title, paths in (("Dependents", dependents), ("Dependencies", dependencies)):
        if paths:
            lines += [f"{title} ({len(paths)}):", *[f"- {p}" for p in paths[:20]]]
            if len(paths) > 20:
                lines.append(f"... and {len(paths) - 20} more")
    lines += ["", f"Request: {request}", ""]
    head = "\n".join(lines)
    out = AssembledContext(head)
    used = len(SYSTEM_PROMPT) + len(head)
    coupling = F.format_string("Ca=%d Ce=%d I=%.2f", "afferent_coupling", "efferent_coupling", F.col("instability").cast("double"))
    mark = F.format_string("[%d] %s lines %d to %d %s (%s, relevance %.3f)", "rank", "path", "line_start", "line_end", "qualified_name", coupling, F.col("score").cast("double"))
    part = F.concat(mark, F.lit("\n~~~\n"), "text", F.lit("\n~~~\n"))
    most = budget.max_chunk_chars
    part = F.when(F.length(part) > most, F.concat(F.substring(part, 1, most), F.lit(_CUT))).otherwise(part)
    named = results.select(F.col("rank").cast("string").alias("id"), "rank", F.format_string("%s:%d-%d", "path", "line_start", "line_end").alias("name"), part.alias("part"))
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "name", "part", F.length("part").alias("size"))))
    whole = ContextBudget(budget.max_total_chars, budget.max_total_chars, budget.max_chunks)  # the parts are cut already
    row = named.agg(items.alias("items")).select("items", first_fit(F.col("items"), whole, used).alias("fold")).first()
    kept = set(row["fold"]["kept"])
    out.included = [x["name"] for x in row["items"] if x["id"] in kept]
    out.excluded = [x["name"] for x in row["items"] if x["id"] not in kept]
    out.prompt += "".join(x["part"] for x in row["items"] if x["id"] in kept)
    out.budget_exhausted = bool(out.excluded)
    out.total_chars = len(out.prompt)
    return out
