"""Reference providers' sheets: three layouts, one long table, event hints from their notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.config import METRIC_OFFSET
from rosterlake.functions.expressions import lookup, month_floor
from rosterlake.functions.text import note_hint, size_value

CURRENT = "headcount_current"


@dataclass(frozen=True)
class SheetLayout:
    """Headers of a provider's sheet; `columns` maps those of values to metrics."""

    provider: str
    name: str
    columns: dict[str, str]
    domain: str | None = None
    profile: str | None = None
    size_range: str | None = None
    note: str | None = None


# Headers of the providers' sheets.
PAST = {
    "Employee Count (6 months ago)": "headcount_6m_ago",
    "Employee Count (1 year ago)": "headcount_1y_ago",
    "Employee Count (2 years ago)": "headcount_2y_ago",
    "Employee Growth % (6 months)": "growth_6m_pct",
    "Employee Growth % (1 year)": "growth_1y_pct",
    "Employee Growth % (2 years)": "growth_2y_pct",
}
LAYOUTS = (
    SheetLayout("primary", "Company Name", {"Headcount": CURRENT, "Headcount % (365d)": "growth_1y_pct", "Headcount % (180d)": "growth_6m_pct", "Web Traffic": "web_traffic"}),
    SheetLayout("secondary", "Company name", PAST, domain="Company Domain Name", size_range="Current Employee Count", note="Assumptions"),
    SheetLayout("tertiary", "Company name", {"Employee Count": CURRENT, **PAST}, domain="Company Domain Name", profile="LinkedIn Domain", size_range="Employee Range", note="Notes"),
)


def load_sheet(sheet: DataFrame, layout: SheetLayout, as_of: Column) -> dict[str, DataFrame]:
    """A sheet (row_index and its own columns) -> rows, one a cell with a value, and hints, one a note that says something.

    Headers match in any case.  A range column, where the sheet has one, alone
    gives the current size, even if it cannot be read.  What is no size but a
    number (a negative growth) counts as an exact value.  Only the current size
    carries the note.  Rows without a name are left out.
    """
    headers = {c.strip().lower(): c for c in sheet.columns}

    def has(label: str | None) -> bool:
        return label is not None and label.lower() in headers

    def cell(label: str | None) -> Column:
        return F.col(f"`{headers[label.lower()]}`").cast("string") if has(label) else F.lit(None).cast("string")

    def text(label: str | None) -> Column:
        return F.nullif(F.trim(cell(label)), F.lit(""))

    if not has(layout.name):
        raise ValueError(f"the {layout.provider} sheet has no column {layout.name!r}")
    ranged = has(layout.size_range)
    wanted = [(label, metric) for label, metric in layout.columns.items() if has(label) and not (ranged and metric == CURRENT)]
    cells = [(label, metric, False) for label, metric in wanted] + ([(layout.size_range, CURRENT, True)] if ranged else [])
    known = sheet.select("row_index", text(layout.name).alias("name"), F.lower(text(layout.domain)).alias("domain"), text(layout.profile).alias("profile_url"), text(layout.note).alias("note"), F.array(*(F.struct(F.lit(label).alias("column"), F.lit(metric).alias("metric"), F.lit(strict).alias("strict"), cell(label).alias("raw")) for label, metric, strict in cells)).alias("cells"))
    known = known.where("name is not null")
    long = known.select("row_index", "name", "domain", "profile_url", "note", F.inline("cells"))
    number = F.col("raw").try_cast("double")
    exact = F.struct(number.alias("value_min"), number.alias("value_point"), number.alias("value_max"), F.lit("exact").alias("kind"))
    value = F.coalesce(size_value("raw"), F.when(~F.col("strict") & number.isNotNull() & ~F.isnan(number), exact))
    shifted = F.add_months(month_floor(as_of), lookup(METRIC_OFFSET, "metric", 0))
    rows = long.withColumn("v", value).where("v is not null").select(
        F.lit(layout.provider).alias("provider"), "row_index", "name", "domain", "profile_url", "metric", F.col("column").alias("source_column"), shifted.alias("as_of_month"), "v.*", F.col("raw").alias("raw_value"), F.when(F.col("metric") == CURRENT, F.col("note")).alias("note")
    )
    hints = known.select(F.lit(layout.provider).alias("provider"), "row_index", "name", "domain", note_hint("note").alias("h")).where("h is not null")
    return {"rows": rows, "hints": hints.select("provider", "row_index", "name", "domain", "h.*")}
