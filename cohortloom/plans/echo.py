"""Echo reports: phrase hits, statistics, the nested JSON and the severity cohorts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators.phrases import (
    catalogue_frame,
    catalogue_rows,
    peek_hits,
    phrase_json,
    phrase_search,
    phrase_stats,
    report_lines,
    severity_cohorts,
)
from ..operators.ranking import value_bounds
from ..sources.tables import materialise
from .note_cohorts import numbered


@dataclass(frozen=True)
class EchoResult:
    hits: DataFrame
    stats: DataFrame
    report: DataFrame
    json: Callable[[], DataFrame]  # a small job finds the ranges of ids first
    cohorts: DataFrame


def echo_notes(noteevents: DataFrame) -> DataFrame:
    return noteevents.filter(F.col("category") == fixed.ECHO_CATEGORY)


def echo_hits(notes: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    return phrase_search(notes, "row_id", "text", [phrase for _, _, phrase in rows], fixed.PHRASE_SLOP)


def echo_severity(noteevents: DataFrame, hits_path: str | None = None, seed: int = 0) -> EchoResult:
    """Search the whole catalogue and derive everything else from the hits.

    With ``hits_path`` the hits are written there once and read by all results; without it every result that is used
    searches for itself.
    """
    notes = echo_notes(noteevents)
    rows = catalogue_rows(fixed.PHRASES)
    catalogue = catalogue_frame(noteevents.sparkSession, rows)
    hits = echo_hits(notes, rows)
    if hits_path is not None:
        hits = materialise(hits, hits_path)
    stats = phrase_stats(hits, catalogue, seed)
    return EchoResult(
        hits=hits,
        stats=stats,
        report=report_lines(stats, catalogue, fixed.CATEGORY_TITLES),
        json=lambda: phrase_json(hits, catalogue, bounds=value_bounds(notes, "row_id")),
        cohorts=severity_cohorts(
            hits, catalogue, notes, "row_id", fixed.SEVERITY_COHORTS, ["row_id", "subject_id", "hadm_id"]
        ),
    )


def cohort_exports(result: EchoResult, noteevents: DataFrame) -> DataFrame:
    """(cohort, ordinal, row_id, subject_id, hadm_id): the severity cohorts as they are exported."""
    places = numbered(echo_notes(noteevents)).select("row_id", "ordinal")
    joined = result.cohorts.join(places, "row_id")
    return joined.select("cohort", "ordinal", "row_id", "subject_id", "hadm_id")


def probe_phrase(noteevents: DataFrame, phrase: str) -> DataFrame:
    """(phrase, rank, doc_id): the document of one phrase at the published rank, and the last."""
    found = phrase_search(echo_notes(noteevents), "row_id", "text", [phrase], fixed.PHRASE_SLOP)
    return peek_hits(found, fixed.PEEK_RANK)
