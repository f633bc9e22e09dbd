"""The staged pipeline: index, classify, annotate, report. Every stage is a function of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import entity_key
from ..operators import dedup, featurize, filters, reports, scoring, state


@dataclass(frozen=True)
class PipelineConfig:
    year_min: int = 1950
    year_max: int = 2026
    threshold: float = 0.45
    reprocess: str = "normal"
    text: featurize.TextFields = field(default_factory=featurize.TextFields)
    ties: tuple[str, ...] = ("file_path", "row_no")
    system: str = ""
    #: Tokens that a prompt may have, the instructions included; none is cut where it is null.
    prompt_tokens: int | None = None


def index_stage(works: DataFrame, seen: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Newest version of each key that passes the structural filter and is newer than the state.

    One scan and one exchange on the key; the state joins on the partitioning that the window left.
    """
    spec = filters.StructuralFilter(year_min=config.year_min, year_max=config.year_max)
    good = filters.with_key(filters.passing(works, spec), entity_key())
    best = dedup.latest_per_key(good, "key", "updated_date", *[t for t in config.ties if t in works.columns])
    return dedup.still_needed(best, seen)


def classify_stage(index: DataFrame, scorer: scoring.Scorer | None = None, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """All candidates with their scores; positives are a filter on what comes out."""
    return scoring.score(featurize.with_text(index, config.text), scorer or scoring.HashScorer(), "text", config.threshold)


def annotate_stage(positives: DataFrame, verdicts: DataFrame, annotator: scoring.Annotator | None = None, config: PipelineConfig = PipelineConfig(), tokens: scoring.Tokens | None = None) -> DataFrame:
    """Annotated records among those that need a verdict, their prompts cut to the budget where there is one."""
    todo = state.pending_records(state.with_work_id(positives), verdicts, config.reprocess)
    asked = scoring.prompts(featurize.paper_text(todo), system=config.system)
    if config.prompt_tokens is not None:
        asked = scoring.fit_prompts(asked, config.prompt_tokens, tokens)
    return scoring.annotate(asked, annotator or scoring.EchoAnnotator())


def new_state(index: DataFrame, seen: DataFrame) -> DataFrame:
    """State after a run: its winners merged into what was there."""
    won = index.select("key", F.col("publication_year").cast("int").alias("year"), "updated_date")
    return dedup.merge_states([seen.select("key", "year", "updated_date"), won])


class Pipeline:
    """Named stages in order; the first error ends the run. Times are kept."""

    def __init__(self, stages: list[tuple[str, Callable[[dict], object]]]):
        self.stages, self.seconds = stages, {}

    def run(self, only: str | None = None) -> dict:
        if only is not None and only not in dict(self.stages):
            raise ValueError(f"unknown stage: {only}")
        done: dict = {}
        for name, f in self.stages:
            if only in (None, name):
                began = time.time()
                done[name] = f(done)
                self.seconds[name] = time.time() - began
        return done


def report_stage(release: DataFrame) -> dict[str, DataFrame]:
    return {
        "trends": reports.trends(release),
        "species": reports.species_report(release),
        "venues": reports.venue_report(release),
        "institutions": reports.institution_report(release),
        "domains": reports.domain_report(release),
    }


def format_duration(seconds: float) -> str:
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m{s % 60:02d}s" if s < 3600 else f"{s // 3600}h{s % 3600 // 60:02d}m"
