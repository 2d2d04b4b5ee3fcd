"""Analyst files: YAML lists of hand-made anchors, read in parallel and validated entry by entry."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Kinds of a value, and the confidence of an entry that states none.
KINDS = ("exact", "range", "bucket")
CONFIDENCE = 0.95

ENTRY = (
    "file string, entry_no int, name string, domain string, profile_url string, anchor_month date, value_min double, value_point double, value_max double,"
    " kind string, confidence double, note string, source_url string, reject_reason string"
)


def _text(value: object) -> str | None:
    return str(value).strip() or None if value else None


def _entry(raw: object) -> dict:
    """The cells of an entry; ValueError with the reason why it is none."""
    if not isinstance(raw, dict):
        raise ValueError("not_a_mapping")
    size = raw.get("headcount")
    if not isinstance(size, dict) or not size:
        raise ValueError("headcount_missing")
    try:
        low, point, high = (float(size[k]) for k in ("min", "point", "max"))
    except (KeyError, TypeError, ValueError):
        raise ValueError("headcount_unreadable") from None
    if not all(map(math.isfinite, (low, point, high))):
        raise ValueError("headcount_unreadable")
    kind = size.get("kind", "exact")
    if kind not in KINDS:
        raise ValueError("unknown_kind")
    note = _text(raw.get("note"))
    if note is None:
        raise ValueError("note_required")
    month = raw.get("anchor_month")
    if isinstance(month, str):
        try:
            month = dt.date.fromisoformat(month)
        except ValueError:
            raise ValueError("month_unreadable") from None
    if not isinstance(month, dt.date):
        raise ValueError("month_unreadable")
    try:
        confidence = float(raw.get("confidence", CONFIDENCE))
    except (TypeError, ValueError):
        raise ValueError("confidence_unreadable") from None
    return {
        "name": _text(raw.get("canonical_name")), "domain": _text(raw.get("domain")), "profile_url": _text(raw.get("linkedin_slug")), "anchor_month": dt.date(month.year, month.month, 1),
        "value_min": low, "value_point": point, "value_max": high, "kind": kind, "confidence": confidence, "note": note, "source_url": _text(raw.get("source_url")),
    }


def _entries(file: str, text: str | None) -> Iterator[dict]:
    import yaml

    try:
        rows = yaml.safe_load(text or "") or []
    except yaml.YAMLError:
        rows = None
    if not isinstance(rows, list):
        yield {"file": file, "reject_reason": "not_a_list"}
        return
    for number, raw in enumerate(rows, 1):
        try:
            yield {"file": file, "entry_no": number, **_entry(raw)}
        except ValueError as e:
            yield {"file": file, "entry_no": number, "reject_reason": str(e)}


def read_analyst_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every file under a path of any store that Spark reads: `rows`, ready for `promotion.manual_entries`, and `rejected`.

    A file is a YAML list; one that is not, and each entry that breaks a rule
    (a headcount with min, point and max, a known kind, a note, a month), is
    rejected with its file, number and reason while the others load.  Files are
    read whole, a row each, so they spread over tasks; entry_id is file and
    number.
    """
    schema = to_arrow_schema(StructType.fromDDL(ENTRY))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(list(_entries(file, text)), schema=schema)

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    every = files.mapInArrow(read, ENTRY).withColumn("entry_id", F.concat_ws("#", "file", F.col("entry_no").cast("string")))
    return {"rows": every.where("reject_reason is null").drop("reject_reason"), "rejected": every.where("reject_reason is not null").select("file", "entry_no", "reject_reason")}
