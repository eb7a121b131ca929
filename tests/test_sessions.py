"""Expected sessions between listing and delisting."""

from __future__ import annotations

from datetime import date

import pytest

from tidemark.operators import quality as ql


def day(x):
    return date.fromisoformat(x) if x else None


def frames(spark, bars, listed):
    b = spark.createDataFrame([(i, day(d), v) for i, d, v in bars], "instrument_id string, trade_date date, dataset_version string")
    return b, spark.createDataFrame([(i, e, day(a), day(z)) for i, e, a, z in listed], "instrument_id string, exchange string, first_trade_date date, delisting_date date")


def test_bounds_lists_and_lost_histories(spark):
    """The week of 4 July 2024, a Thursday."""
    bars = [("a", f"2024-07-0{n}", "v") for n in (1, 2, 3, 4, 5)] + [("a", "2024-07-02", "v"), ("b", "2024-07-01", "v"), ("b", "2024-07-03", "v"), ("c", "2024-07-06", "v")]
    listed = [("a", "XNYS", None, None), ("b", "XNAS", "2024-07-02", "2024-07-05"), ("c", "XNYS", "2024-07-05", "2024-07-05"), ("d", "XNYS", "2024-07-01", None), ("e", "XNYS", "2024-08-01", None), ("f", "XNYS", None, None)]
    got = {r.instrument_id: r for r in ql.session_completeness(*frames(spark, bars, listed), day("2024-07-08")).collect()}
    show = lambda r: ([str(x) for x in r.missing], [str(x) for x in r.unexpected], r.expected, r.observed, r.duplicates, r.missing_history, r.complete)
    assert show(got["a"]) == (["2024-07-08"], ["2024-07-04"], 5, 6, 1, False, False)
    assert show(got["b"]) == (["2024-07-02", "2024-07-05"], ["2024-07-01"], 3, 2, 0, False, False)
    assert show(got["c"]) == (["2024-07-05"], ["2024-07-06"], 1, 1, 0, False, False)
    assert got["d"].missing_history and not got["e"].missing_history and got["e"].complete and got["f"].missing_history
    later = {r.instrument_id: r for r in ql.session_completeness(*frames(spark, [("b", "2024-07-03", "v"), ("b", "2024-07-05", "v")], listed[1:2]), day("2024-07-08"), day("2024-07-03")).collect()}
    assert later["b"].complete and later["b"].expected == 2


@pytest.mark.parametrize(
    "bars, listed, span",
    [
        ([], [("a", "XNYS", None, None)], ("2024-07-08", None)),
        ([("a", "2024-07-01", "v"), ("a", "2024-07-02", "w")], [("a", "XNYS", None, None)], ("2024-07-08", None)),
        ([("a", "2024-07-09", "v")], [("a", "XNYS", None, None)], ("2024-07-08", None)),
        ([("a", "2024-07-01", "v")], [("a", "XNYS", None, None)], ("2024-07-08", "2024-07-02")),
        ([("a", "2024-07-01", "v")], [("a", "XLON", None, None)], ("2024-07-08", None)),
        ([("a", "2024-07-01", "v")], [("a", "XNYS", None, None), ("a", "XNYS", None, None)], ("2024-07-08", None)),
        ([("b", "2024-07-01", "v")], [("a", "XNYS", None, None)], ("2024-07-08", None)),
    ],
    ids=["no bars", "versions", "after the end", "before the start", "exchange", "repeated", "unknown"],
)
def test_audits_that_cannot_be_made(spark, bars, listed, span):
    with pytest.raises(ValueError):
        ql.session_completeness(*frames(spark, bars, listed), day(span[0]), day(span[1]))
