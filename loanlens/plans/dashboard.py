"""The whole dashboard as one batch job: build the tables, then every report.

``refresh`` writes the five cleaned tables and the wide master table
(``gold.build_tables``), reads them back so every report starts from saved
tables instead of the raw lineage, materializes the slim risk table once as a
reliable checkpoint (nine reports read it), and writes each report to its own
table ``report_<name>``.  Each step is an ordinary distributed job; nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..sources.sinks import save
from . import gold, quality, reports
from .context import LendingData

REPORT_FUNCTIONS = {
    **reports.REPORTS,
    "portfolio_summary": quality.portfolio_summary,
    "completeness": quality.completeness,
}


def refresh(ctx: LendingData, database: str, fmt: str = "parquet", buckets: int | None = None,
            names: Iterable[str] | None = None) -> dict[str, str]:
    """Rebuild the tables of ``database`` and write the reports; returns
    name -> qualified table (the built tables and ``report_<name>`` tables).

    The tables are staged and swapped, so ``ctx`` may be ``gold.from_tables`` of
    the same database, and readers see the old tables until all new ones stand.
    ``ctx`` itself is stale then; make a new one."""
    out = gold.build_tables(ctx, database, fmt=fmt, buckets=buckets, rollups=bool(buckets), staged=True)
    saved = gold.from_tables(ctx.spark, database)
    saved.persist_slim()
    saved.persist_scored()
    for name in names or REPORT_FUNCTIONS:
        out[f"report_{name}"] = save(REPORT_FUNCTIONS[name](saved), f"report_{name}", fmt=fmt, database=database)
    return out
