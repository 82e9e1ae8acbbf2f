"""Compositions of the operators for whole portfolios."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from unitwise.operators import cells as C
from unitwise.operators import codes, prove, quality, score, stats
from unitwise.operators import walk as W
from unitwise.session import stage


class Verified(NamedTuple):
    summary: DataFrame
    charges: DataFrame
    issues: DataFrame
    checks: DataFrame
    tally: DataFrame


def verify_portfolio(units: DataFrame, charges: DataFrame, stated: DataFrame,
                     proposals: DataFrame | None = None) -> Verified:
    """Categories, statistics, issues and checks of every document."""
    lines = codes.drop_total_lines(charges)
    if proposals is not None:
        lines = codes.apply_code_proposals(lines, proposals)
    checks = quality.verify(units, stated)
    return Verified(
        stats.summary_stats(units, lines), codes.charge_summary(lines),
        quality.validate(units, stated), checks, quality.check_tally(checks))


class Reading(NamedTuple):
    units: DataFrame
    lines: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def read_sheets(cells: DataFrame, structures: DataFrame) -> Reading:
    """Walk all sheets, keep the convention each proves, and drop fee codes from rent.

    ``rejected`` lists sheets no convention proved; they need another reading.
    """
    walked = W.walk(cells, structures, keep_blocks=True)
    walked = walked._replace(units=stage(walked.units), lines=stage(walked.lines))
    heads = C.header_text(C.sheet_grid(cells))
    stated = prove.sheet_stated(structures)
    accepted = stage(prove.choose_convention(walked, stated, heads))
    units = prove.accepted_units(walked, accepted)
    units, _ = prove.narrow_fee_codes(units, walked.lines, walked.plan, accepted)
    rejected = walked.plan.select(*W.SHEET).join(accepted, W.SHEET, "left_anti")
    return Reading(units, walked.lines, accepted, rejected)


class Scored(NamedTuple):
    cells: DataFrame
    files: DataFrame
    report: DataFrame
    worst: DataFrame


def score_portfolio(truth: DataFrame, found: DataFrame, fields: DataFrame | None = None) -> Scored:
    """Align, grade and roll up all documents."""
    cells = stage(score.score_cells(truth, found, stage(score.align(truth, found)), fields))
    files = score.file_scores(cells, truth)
    return Scored(cells, files, score.score_report(files), score.worst_fields(cells))
