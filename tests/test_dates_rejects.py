"""Date formats inferred from whole columns, Windows-1252 text, and rows that cannot be read."""

import pytest
from pyspark.sql import functions as F

from custvalue.config import Settings
from custvalue.operators.clean import clean_data
from custvalue.sources.csv import load_and_validate, load_csv
from custvalue.sources.dates import AmbiguousDates, date_formats, parsed
from custvalue.sources.rejects import CORRUPT, REASONS, accepted_and_rejected

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def formats_of(spark, texts):
    return date_formats(spark.createDataFrame([(t,) for t in texts], "InvoiceDate string"))


@pytest.mark.parametrize(
    "texts, want",
    [
        (["12/1/2010 8:26", "12/13/2010 18:06", None, " "], ["M/d/yyyy H:m"]),
        (["1.12.2010", "13.12.2010"], ["d.M.yyyy"]),
        (["2010-12-01 08:26:00", "2010-01-02 00:00:00"], ["yyyy-M-d H:m:s"]),
        (["2010-12-01T08:26:00"] * 3 + ["2010-12-01"], ["yyyy-M-d'T'H:m:s", "yyyy-M-d"]),
        (["1/2/2010", "1/2/2010 8:00", "30/2/2010 8:00", "3/1/2010 8:00"], ["d/M/yyyy H:m", "d/M/yyyy"]),  # decide together
        (["soon", "12/13/2010"], ["M/d/yyyy"]),
        ([], []),
        ([None], []),
    ],
)
def test_formats_follow_from_the_column(spark, texts, want):
    assert formats_of(spark, texts) == want


@pytest.mark.parametrize("texts", [["1/2/2010", "12/11/2010"], ["soon"], ["13/1/2010", "1/13/2010"], ["1/2/10"]])
def test_what_cannot_be_decided_raises(spark, texts):
    with pytest.raises(AmbiguousDates):
        formats_of(spark, texts)


def test_texts_that_do_not_fit_become_null(spark):
    df = spark.createDataFrame([("12/1/2010 8:26",), ("2/30/2010 8:26",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(parsed(F.col("t"), ["M/d/yyyy H:m"]).cast("string")).collect()]
    assert got == ["2010-12-01 08:26:00", None, None, None]


def test_retail_dates_load_without_configuration(spark, tmp_path):
    path = tmp_path / "retail.csv"
    path.write_text(HEADER + "536365,85123A,HEART,6,12/1/2010 8:26,2.55,17850,UK\n536366,71053,LANTERN,6,12/13/2010 18:05,3.39,17850,UK\n")
    df, check = load_and_validate(spark, str(path))
    got = sorted(r["InvoiceDate"].isoformat() for r in clean_data(df).collect())
    assert got == ["2010-12-01T08:26:00", "2010-12-13T18:05:00"] and check["missing_columns"] == []
    path.write_text(HEADER + "536365,85123A,HEART,6,12/1/2010 8:26,2.55,17850,UK\n")
    with pytest.raises(AmbiguousDates):
        load_and_validate(spark, str(path))
    df, _ = load_and_validate(spark, str(path), Settings(date_format="M/d/yyyy H:mm"))
    assert clean_data(df, Settings(date_format="M/d/yyyy H:mm")).count() == 1


def test_windows_1252_signs(spark, tmp_path):
    path = tmp_path / "windows.csv"
    text = "name,price\n“café” – naïve,€5\n"
    path.write_bytes(text.encode("cp1252"))
    assert [tuple(r) for r in load_csv(spark, str(path), "cp1252").collect()] == [("“café” – naïve", "€5")]


def test_rejects_and_accepted_rows_are_all_rows(spark, tmp_path):
    path = tmp_path / "faults.csv"
    good = "1,A,x,6,12/13/2010 8:26,2.5,17850,UK\n"
    lines = [good, good.replace("6,", "six,", 1), good.replace("2.5", "free"), good.replace("17850", "guest"),
             good.replace("12/13/2010 8:26", "soon"), good.replace("12/13/2010 8:26", ""), "1,A,x\n", good.replace("17850", ""), good]
    path.write_text(HEADER + "".join(lines))
    df = load_csv(spark, str(path), "utf-8", corrupt_column=CORRUPT)
    accepted, rejected = accepted_and_rejected(df, ["M/d/yyyy H:m"])
    assert accepted.columns == df.columns[:-1] and accepted.count() == 3
    reasons = sorted(r["reject_reason"] for r in rejected.collect())
    assert reasons == sorted([REASONS[0], *REASONS[1:4], REASONS[4], REASONS[4]])
    assert accepted_and_rejected(df.filter("false"))[1].count() == 0
