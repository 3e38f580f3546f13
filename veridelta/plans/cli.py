"""python -m veridelta compare --config FILE [--output DIR] | demo [--output DIR]; prints the report's path."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.readers import make_demo, read_config, read_data
from .comparison import Comparison, compare_predictions
from .config import InferenceConfig, Slice, TemporalConfig, TradeViewConfig
from .report import export


def _slice(s: str | dict) -> Slice:
    if isinstance(s, str):
        return Slice(s)
    return Slice(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()})


def run_config(spark: SparkSession, path: str, output: str | None = None) -> Path:
    """Runs a JSON file's settings; its paths are relative to it."""
    cfg, here = read_config(path), Path(path).resolve().parent
    ids = [c for c in (cfg["comparison"].get("id_column"),) if c]
    source = cfg["data_path"] if "://" in cfg["data_path"] else str(here / cfg["data_path"])
    data = read_data(source, spark=spark, string_columns=ids if source.endswith(".csv") else None)
    c = compare_predictions(data, **cfg["comparison"])
    pairs = cfg.get("interactions", [])
    if any(len(p) != 2 for p in pairs):
        raise ValueError("an interaction has two members")
    keep = {k: cfg[k] for k in ("min_count", "metric", "include_candidate", "candidate_population", "candidate_top_n", "temporal_population", "temporal_entity") if k in cfg}
    made = {k: make(**cfg[k]) for k, make in (("inference", InferenceConfig), ("temporal", TemporalConfig), ("trades", TradeViewConfig)) if cfg.get(k)}
    return export(c, output or str(here / cfg.get("output", "reports")), slices=[_slice(s) for s in cfg["slices"]] if cfg.get("slices") is not None else None, interactions=[(_slice(a), _slice(b)) for a, b in pairs], **keep, **made)


def demo(spark: SparkSession, n: int = 1200) -> Comparison:
    return compare_predictions(make_demo(spark, n), "actual", "reference_prediction", "candidate_prediction", id_column="row_id", time_column="time", entity_column="entity_id")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veridelta")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compare")
    one.add_argument("--config", required=True)
    for p in (one, commands.add_parser("demo")):
        p.add_argument("--output")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("veridelta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folder = run_config(spark, a.config, a.output) if a.command == "compare" else export(demo(spark), a.output or "reports", slices=[Slice("segment"), Slice("category")], temporal=TemporalConfig())
    print(folder / "report.html")
