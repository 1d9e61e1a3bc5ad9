"""The registry of reports: which there are, in which profiles they run, and a runner that no failing report stops."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cairn.config import PROFILES

ALL = tuple(PROFILES)
MOST = tuple(p for p in PROFILES if p != "minimal")
REVIEW = ("full", "ai_review", "security")


@dataclass(frozen=True)
class Report:
    """A report: its name, the profiles in which it runs, what it says, and what builds it."""

    name: str
    profiles: tuple[str, ...]
    about: str
    build: Callable[[SparkSession, str], DataFrame]

    def runs_in(self, profile: str) -> bool:
        """The profile full runs every report."""
        return profile == "full" or profile in self.profiles


class Catalogue:
    """Reports by name, in the order in which they were added; a name is taken once."""

    def __init__(self) -> None:
        self.reports: dict[str, Report] = {}

    def add(self, name: str, profiles: tuple[str, ...], about: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
        if name in self.reports:
            raise ValueError(f"{name} is taken")
        if unknown := set(profiles) - set(PROFILES):
            raise ValueError(f"unknown profile {min(unknown)}")
        self.reports[name] = Report(name, tuple(profiles), about, build)

    def of(self, profile: str) -> list[Report]:
        return [r for r in self.reports.values() if r.runs_in(profile)]

    def table(self, spark: SparkSession) -> DataFrame:
        """place, report, profile, runs: what runs where."""
        rows = [(k, r.name, p, r.runs_in(p)) for k, r in enumerate(self.reports.values(), 1) for p in PROFILES]
        return spark.createDataFrame(rows, "place int, report string, profile string, runs boolean")


@dataclass
class Progress:
    """What a run tells while it goes: started, progress, finished or log, for a step."""

    kind: str
    step: str
    text: str = ""
    at: float = field(default_factory=time.time)


def run(catalogue: Catalogue, profile: str, spark: SparkSession, folder: str, write: Callable[[str, DataFrame], None], cancelled: Callable[[], bool] = lambda: False, tell: Callable[[Progress], None] = lambda _: None) -> Iterator[tuple[str, str, str]]:
    """report, outcome (done, failed, cancelled), error: runs the reports of a profile one by one.

    A report that fails is told as such and stops no other; once cancelled, those that are left are cancelled.
    """
    for report in catalogue.of(profile):
        if cancelled():
            yield report.name, "cancelled", ""
            continue
        tell(Progress("started", report.name))
        try:
            write(report.name, report.build(spark, folder))
            outcome, error = "done", ""
        except Exception as e:  # whatever a report does, the others run
            outcome, error = "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            tell(Progress("log", report.name, error))
        tell(Progress("finished", report.name, outcome))
        yield report.name, outcome, error
