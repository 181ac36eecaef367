"""Settings shared by all operators. Plain values only; nothing here touches data."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# Canonical transaction columns, in table order.
TRANSACTION_COLUMNS = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
)


@dataclass(frozen=True)
class RfmWeights:
    recency: float = 0.25
    frequency: float = 0.35
    monetary: float = 0.40


@dataclass(frozen=True)
class LinearParams:
    fit_intercept: bool = True


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    depth: int = 10
    min_leaf: int = 2
    min_split: int = 2  # through the leaf size, see operators.models.leaf_size
    seed: int = 42


@dataclass(frozen=True)
class BoostingParams:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    row_sample: float = 0.8
    column_sample: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    """Every tunable of the library.

    ``columns`` maps a canonical transaction column to its name in the source;
    columns left out keep their canonical name.
    """

    columns: dict[str, str] = field(default_factory=dict)
    encoding: str = "UTF-8"
    date_format: str | None = None
    processed_path: str = "data/processed/transactions"
    features_path: str = "data/processed/features"
    models_path: str = "models"
    weights: RfmWeights = RfmWeights()
    linear: LinearParams = LinearParams()
    forest: ForestParams = ForestParams()
    boosting: BoostingParams = BoostingParams()
    test_share: float = 0.2
    seed: int = 42
    folds: int = 5
    # A customer with more lines than this gets its median from the range-sorted
    # path instead of a per-customer aggregation buffer.
    hot_customer_lines: int = 1_000_000

    def source_name(self, canonical: str) -> str:
        return self.columns.get(canonical, canonical)

    @property
    def required_columns(self) -> list[str]:
        return [self.source_name(c) for c in TRANSACTION_COLUMNS]


# Settings file keys of the transaction columns.
COLUMN_KEYS = {
    "invoice_no": "InvoiceNo",
    "stock_code": "StockCode",
    "description": "Description",
    "quantity": "Quantity",
    "invoice_date": "InvoiceDate",
    "unit_price": "UnitPrice",
    "customer_id": "CustomerID",
    "country": "Country",
}
# Settings file keys of the other sections, with our names.
WEIGHT_KEYS = {"recency_weight": "recency", "frequency_weight": "frequency", "monetary_weight": "monetary"}
FOREST_KEYS = {
    "n_estimators": "trees",
    "max_depth": "depth",
    "min_samples_leaf": "min_leaf",
    "min_samples_split": "min_split",
    "random_state": "seed",
}
BOOSTING_KEYS = {
    "n_estimators": "rounds",
    "max_depth": "depth",
    "learning_rate": "rate",
    "subsample": "row_sample",
    "colsample_bytree": "column_sample",
    "random_state": "seed",
}


def _updated(default, section: dict, keys: dict[str, str]):
    return replace(default, **{ours: section[theirs] for theirs, ours in keys.items() if theirs in section})


def settings_from(tree: dict) -> Settings:
    """Settings from the nested mapping of a settings file; whatever is absent keeps its default."""
    data, models = tree.get("data", {}), tree.get("models", {})
    weights = tree.get("features", {}).get("rfm", {})
    training = tree.get("training", {})
    base = Settings()
    named = {COLUMN_KEYS[k]: v for k, v in data.get("columns", {}).items() if k in COLUMN_KEYS}
    return replace(
        base,
        columns=named,
        encoding=data.get("encoding", base.encoding),
        processed_path=data.get("processed_data_path", base.processed_path),
        features_path=data.get("features_path", base.features_path),
        models_path=models.get("save_path", base.models_path).rstrip("/"),
        weights=_updated(base.weights, weights, WEIGHT_KEYS),
        linear=_updated(base.linear, models.get("linear_regression", {}), {"fit_intercept": "fit_intercept"}),
        forest=_updated(base.forest, models.get("random_forest", {}), FOREST_KEYS),
        boosting=_updated(base.boosting, models.get("xgboost", {}), BOOSTING_KEYS),
        test_share=training.get("test_size", base.test_share),
        seed=training.get("random_state", base.seed),
        folds=training.get("cross_validation_folds", base.folds),
    )


def load_settings(path: str | None) -> Settings:
    """Settings from a YAML file on the driver; the defaults where there is no file."""
    if path is None or not os.path.exists(path):
        return Settings()
    import yaml  # only needed for settings files

    with open(path, encoding="utf-8") as file:
        return settings_from(yaml.safe_load(file) or {})
