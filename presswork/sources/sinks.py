"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, n_files: int | None = None, mode: str = "error") -> None:
    """JSON lines. As many files as tasks, unless ``n_files`` asks for a shuffle into that many;
    a shuffle keeps the work before it parallel, which ``coalesce`` would not."""
    (df if n_files is None else df.repartition(n_files)).write.mode(mode).json(path)


def write_config(json_rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row table with a JSON text column ``value``."""
    json_rows.select("value").coalesce(1).write.mode(mode).text(path)


def write_report_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows (a few per model) as one CSV file with the label as first column."""
    others = [c for c in report.columns if c != "label"]
    report.select("label", *others).repartition(1).write.mode(mode).option("header", True).csv(path)


def write_trials_csv(trials: DataFrame, path: str, mode: str = "overwrite") -> None:
    trials.write.mode(mode).option("header", True).csv(path)


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split; rows carry their key, so features and labels cannot get out of step."""
    features.write.mode(mode).partitionBy("split").parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    predictions.write.mode(mode).parquet(path)


def write_fold_weights(model: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Linear model rows, one folder per fold."""
    model.write.mode(mode).partitionBy("fold").parquet(path)
