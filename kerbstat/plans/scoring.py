"""Batch scoring of requests: where and when a citation might be issued."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.operators.features import add_location, add_temporal, add_violation, clean
from kerbstat.plans.model import ClassModel
from kerbstat.schema import CODE, DATE, FINE

ECHO = ["latitude", "longitude", "datetime", "precinct", "county"]

# What stands in for a request column that is missing or null.
REQUEST_DEFAULTS = {
    "precinct": "UNKNOWN",
    "county": "NY",
    "street_name": "",
    "agency": "P",
    "plate_type": "PAS",
}


def complete(requests: DataFrame, now: datetime | None = None) -> DataFrame:
    """All request columns, defaults put in, and ``error``: the columns that could not be read, or null.

    A missing time is ``now``, or the time of the query.
    """

    def given(name: str, type_: str) -> Column:
        return F.col(name).try_cast(type_) if name in requests.columns else F.lit(None).cast(type_)

    typed = {"latitude": "double", "longitude": "double", "datetime": "timestamp"}
    unread = [
        F.when(F.col(c).isNotNull() & given(c, type_).isNull(), F.lit(f"unreadable {c}"))
        for c, type_ in typed.items()
        if c in requests.columns
    ]
    problems = F.concat_ws(", ", *unread) if unread else F.lit("")
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return requests.withColumns(
        {
            "error": F.nullif(problems, F.lit("")),
            "latitude": given("latitude", "double"),
            "longitude": given("longitude", "double"),
            "datetime": F.coalesce(given("datetime", "timestamp"), moment),
            **{c: F.coalesce(given(c, "string"), F.lit(v)) for c, v in REQUEST_DEFAULTS.items()},
        }
    )


def request_features(requests: DataFrame) -> DataFrame:
    """Completed requests (see :func:`complete`) as a feature frame; the hour is that of the request's time."""
    as_citations = requests.withColumns(
        {
            DATE: F.col("datetime").cast("date"),
            "violation_time": F.date_format("datetime", "HHmm"),
            "issuing_agency": F.col("agency"),
            CODE: F.lit(None).cast("string"),
            FINE: F.lit(0).cast("decimal(10,2)"),
        }
    )
    return (
        as_citations.transform(add_temporal)
        .transform(add_location, True)
        .transform(add_violation)
        .transform(clean, (DATE,))
    )


def score(requests: DataFrame, model: ClassModel, k: int = 5, now: datetime | None = None) -> DataFrame:
    """Requests with predicted class, confidence, the ``k`` likeliest classes and the input used.

    Further columns of the requests, such as an id, are kept. A request with a value that cannot be
    read keeps its row, with the reason in ``error`` and no prediction.
    """
    inputs = complete(requests, now)
    known = [*ECHO, *REQUEST_DEFAULTS, "error"]
    extra = F.struct(F.lit(True).alias("_"), *[c for c in requests.columns if c not in known])
    frame = request_features(inputs.withColumns({"_extra": extra, "_input": F.struct(*ECHO)}))
    scored = model.predict_names(model.encode(frame.select("_extra", "_input", "error", *model.features)), k)
    fine = F.col("error").isNull()
    return scored.select(
        "_extra.*",
        F.when(fine, F.col("predicted")).alias("predicted_violation"),
        F.when(fine, F.col("confidence")).alias("confidence"),
        F.when(fine, F.col("top_predictions")).alias("top_predictions"),
        F.col("_input").alias("input"),
        "error",
    ).drop("_")
