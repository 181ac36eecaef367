import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from custvalue.config import Settings, load_settings
from custvalue.operators import clean, validate
from custvalue.sources.csv import load_and_validate, load_csv
from custvalue.sources.sinks import save_predictions, save_processed_data, save_table

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
ROWS = [
    "INV1,S1,mug,2,2020-01-01 10:00:00,1.5,17850.0,France",
    "INV1,S1,mug,2,2020-01-01 10:00:00,1.5,17850,France",  # the same row, other spelling
    "INV1,S2,pen,1,2020-01-02 11:00:00,2.5,17850,France",
    "CINV2,S1,mug,-2,2020-01-03 10:00:00,1.5,17850,France",  # cancelled
    ",S1,mug,3,2020-01-03 10:00:00,1.0,17851,Spain",  # no invoice: kept
    "INV3,S1,mug,0,2020-01-03 10:00:00,1.0,17851,Spain",  # quantity
    "INV4,S1,mug,x,2020-01-03 10:00:00,1.0,17851,Spain",  # quantity is no number
    "INV5,S1,mug,1,2020-01-03 10:00:00,0,17851,Spain",  # price
    "INV6,S1,mug,1,not a date,1.0,17851,Spain",  # date
    "INV7,S1,mug,1,2020-01-03 10:00:00,1.0,,Spain",  # customer
]


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(HEADER + "\n".join(ROWS) + "\n")
    return str(path)


def test_load_csv_counts_rows(spark, csv_path):
    assert load_csv(spark, csv_path).count() == len(ROWS)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path / "nonexistent.csv"))


def test_encoding_falls_back_to_latin1(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name\ncafé\n".encode("latin1"))
    assert load_csv(spark, str(path)).first()["name"] == "café"
    assert load_csv(spark, str(path), encoding="latin1").first()["name"] == "café"


def test_schema_and_reader_options(spark, tmp_path):
    path = tmp_path / "semi.csv"
    path.write_text("a;b\n1;2.5\n")
    df = load_csv(spark, str(path), schema="a int, b double", sep=";")
    assert df.first().asDict() == {"a": 1, "b": 2.5}


def test_load_and_validate(spark, csv_path):
    _, check = load_and_validate(spark, csv_path)
    assert check == {"is_valid": True, "missing_columns": [], "extra_columns": []}


def test_column_check_reports_missing_and_extra(spark):
    df = spark.createDataFrame([("a", 1)], "InvoiceNo string, other int")
    check = validate.column_check(df)
    assert not check["is_valid"]
    assert "Quantity" in check["missing_columns"]
    assert check["extra_columns"] == ["other"]


def test_clean_data_keeps_exactly_the_valid_rows(spark, csv_path):
    rows = clean.clean_data(load_csv(spark, csv_path)).collect()
    assert sorted((r["CustomerID"], r["InvoiceNo"] or "", r["TotalAmount"]) for r in rows) == [
        ("17850", "INV1", 2.5),
        ("17850", "INV1", 3.0),
        ("17851", "", 3.0),
    ]
    first = next(r for r in rows if r["TotalAmount"] == 3.0 and r["CustomerID"] == "17850")
    assert (first["Year"], first["Month"], first["DayOfWeek"], first["Hour"]) == (2020, 1, 2, 10)


def test_step_counts(spark, csv_path):
    counts = {r["step"]: r["rows_removed"] for r in clean.step_counts(load_csv(spark, csv_path)).collect()}
    assert counts == {
        "duplicates": 1,
        "missing_customers": 1,
        "cancelled": 1,
        "invalid_quantities": 2,
        "invalid_prices": 1,
        "invalid_dates": 1,
    }


def test_steps_can_be_switched_off(spark, csv_path):
    df = load_csv(spark, csv_path)
    assert clean.clean_data(df, cancelled=False, quantities=False).count() == 6
    assert clean.clean_data(df, duplicates=False).count() == 4


def test_configured_column_names_and_date_format(spark):
    settings = Settings(columns={"CustomerID": "client", "InvoiceDate": "day"}, date_format="dd/MM/yyyy")
    df = spark.createDataFrame(
        [("I1", "S", "d", "2", "31/12/2020", "1.5", "7", "X"), ("I2", "S", "d", "2", "2020-12-31", "1.5", "7", "X")],
        "InvoiceNo string, StockCode string, Description string, Quantity string, day string, "
        "UnitPrice string, client string, Country string",
    )
    rows = clean.clean_data(df, settings).collect()
    assert [(r["CustomerID"], str(r["InvoiceDate"])) for r in rows] == [("7", "2020-12-31 00:00:00")]


def test_non_numeric_customer_raises(spark):
    df = spark.createDataFrame(
        [("I1", "S", "d", 2, "2020-12-31", 1.5, "abc", "X")],
        "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, "
        "UnitPrice double, CustomerID string, Country string",
    )
    with pytest.raises(PySparkException):
        clean.clean_data(df).collect()


def test_preprocessing_stats_of_empty_table(spark, csv_path):
    empty = load_csv(spark, csv_path).where(F.lit(False))
    row = clean.preprocessing_stats(empty, empty).first()
    assert row["rows_before"] == 0 and row["removal_percentage"] is None


def test_schema_summary(spark, csv_path):
    summary = validate.schema_summary(clean.clean_data(load_csv(spark, csv_path)))
    assert "Quantity" in summary["numeric_columns"]
    assert "Country" in summary["categorical_columns"]
    assert {"InvoiceDate", "Date"} <= set(summary["datetime_columns"])


def test_approximate_distinct_profile(spark, csv_path):
    exact = {r["column"]: r["distinct_count"] for r in validate.distinct_profile(load_csv(spark, csv_path)).collect()}
    near = {
        r["column"]: r["distinct_count"]
        for r in validate.distinct_profile(load_csv(spark, csv_path), approximate=True).collect()
    }
    assert exact == near  # sketches are exact for so few values


def test_csv_sink_round_trip(spark, csv_path, tmp_path):
    cleaned = clean.clean_data(load_csv(spark, csv_path))
    path = save_processed_data(cleaned, str(tmp_path / "deep" / "folder" / "out"))
    back = load_csv(spark, path)
    assert back.columns == cleaned.columns
    assert back.count() == cleaned.count()


def test_partitioned_prediction_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 5.0, "Low"), ("2", 9.0, "High")], "CustomerID string, Predicted_CLV double, CLV_Segment string"
    )
    path = save_predictions(df, str(tmp_path / "p"), fmt="parquet", by_segment=True)
    assert spark.read.parquet(path).where("CLV_Segment = 'High'").first()["CustomerID"] == "2"
    with pytest.raises(ValueError):
        save_table(df, str(tmp_path / "q"), fmt="xls")


def test_settings_file(tmp_path):
    path = tmp_path / "settings.yaml"
    path.write_text(
        "data:\n  columns:\n    customer_id: client\n"
        "features:\n  rfm:\n    recency_weight: 0.5\n"
        "models:\n  save_path: out/\n  random_forest:\n    n_estimators: 7\n  xgboost:\n    learning_rate: 0.3\n"
        "training:\n  test_size: 0.3\n"
    )
    got = load_settings(str(path))
    assert got.source_name("CustomerID") == "client" and got.source_name("Country") == "Country"
    assert got.weights.recency == 0.5 and got.weights.monetary == 0.40
    assert got.forest.trees == 7 and got.forest.depth == 10 and got.boosting.rate == 0.3
    assert got.models_path == "out" and got.test_share == 0.3
    assert load_settings(str(tmp_path / "absent.yaml")) == Settings()
