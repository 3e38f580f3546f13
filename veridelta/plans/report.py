"""A run's tables as a folder of files: CSV, a JSON manifest and an HTML page."""

from __future__ import annotations

import html
import json
import math
import secrets
from dataclasses import asdict
from datetime import UTC, date, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.figures import label_grid
from ..operators.folds import WalkForwardResult
from ..operators.metrics import METRICS, as_slice
from ..sources.tables import written
from .comparison import Comparison
from .config import InferenceConfig, Slice, TemporalConfig, TradeViewConfig, default_slices, one_of, positive

#: Rows of a table that are shown in the page; the CSV has all.
SHOWN = 200


def plain(x: object) -> object:
    """JSON without NaN: infinities as text, NaN as null."""
    if isinstance(x, float):
        return None if math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else x
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, (str, int, bool)) else x.isoformat() if isinstance(x, (date, datetime)) else str(x)


def _cell(x: object) -> str:
    return html.escape(f"{x:,.5g}" if isinstance(x, float) else "" if x is None else str(x))


def _table(df: pd.DataFrame) -> str:
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(x)}</td>" for x in row) + "</tr>" for row in df.head(SHOWN).itertuples(index=False))
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" + (f"<p>{len(df)} rows; the first {SHOWN} are shown.</p>" if len(df) > SHOWN else "")


def _axes(slices: list[Slice], interactions: list[tuple]) -> list[Slice]:
    """The slices, and the axes that only interactions name."""
    return list(dict.fromkeys([*slices, *[x for pair in interactions for x in pair]]))


def export(c: Comparison, output: str, *, slices: list[Slice | str] | None = None, interactions: list[tuple] | None = None, min_count: int = 30, metric: str = "mae_delta", inference: InferenceConfig | None = None, include_candidate: bool = True, candidate_population: str = "candidate", candidate_top_n: int = 20, temporal: TemporalConfig | None = None, temporal_population: str | None = None, temporal_entity: object = None, trades: TradeViewConfig | None = None) -> Path:
    """Writes a new folder and gives its path. Only aggregated, bounded tables come to the driver.

    The evaluation rows are prepared once, all tables are read from there, and they are deleted at the end. slices None
    takes the default ones; metric is what slices are ordered by in the page and what interactions' grids show."""
    policy = (inference or InferenceConfig()).resolved(c.roles)
    one_of("candidate_population", candidate_population, ("candidate", "paired"))
    temporal_population = candidate_population if temporal_population is None else temporal_population
    one_of("temporal_population", temporal_population, ("candidate", "paired"))
    positive("candidate_top_n", candidate_top_n)
    one_of("metric", metric, tuple(METRICS))
    specs = default_slices(c.roles) if slices is None else [as_slice(s) for s in slices]
    pairs = [(as_slice(x), as_slice(y)) for x, y in interactions or []]
    folder = Path(output) / f"review_{datetime.now(UTC):%Y%m%dT%H%M%SZ}_{secrets.token_hex(4)}"
    folder.mkdir(parents=True, exist_ok=False)
    source, c = c, c.prepare()
    try:
        sections: dict[str, dict[str, DataFrame | pd.DataFrame]] = {"Overview": {"coverage": c.coverage(), "summary": c.summary(min_count), "missingness": c.missingness()}}
        sections["Inference"] = {"paired_test": c.paired_test(inference, min_count)}
        sections["Slices"] = {}
        for i, s in enumerate(specs, 1):
            sections["Slices"] |= {f"slice_{i:02d}": metrics.slice_metrics(c.rows, s, **c._options(min_count)).orderBy(F.desc_nulls_last(metric), "group"), f"slice_{i:02d}_test": c.slice_test(s, inference, min_count)}
        for i, (x, y) in enumerate(pairs, 1):
            cells = written(c.cross_slice(x, y, min_count=min_count), "cells")
            sections["Slices"] |= {f"interaction_{i:02d}": cells, f"interaction_{i:02d}_grid": label_grid(cells, metric), f"interaction_{i:02d}_test": c.cross_slice_test(x, y, inference, min_count)}
        if include_candidate:
            found = c.candidate_diagnostics(_axes(specs, pairs), population=candidate_population, min_count=min_count, top_n=candidate_top_n)
            shown = {f"figure_{k}": v for k, v in c.figure_tables(population=candidate_population).items() if k != "calibration"}
            sections["Candidate"] = {f"candidate_{k}": v for k, v in (found | shown).items()}
        settings: dict = {}
        if temporal:
            found = c.temporal_diagnostics(temporal, population=temporal_population, entity=temporal_entity)
            sections["Temporal"] = {f"temporal_{k}": v if isinstance(v, DataFrame) else pd.DataFrame(v if isinstance(v, list) else [v]) for k, v in found.items()}
            settings["temporal"] = asdict(temporal)
        if trades:
            found = c.trade_diagnostics(trades)
            sections["Trades"] = {"trade_summary": pd.DataFrame([found["summary"]]), "trade_intraday": found["intraday"], "trade_points": found["points"]}
            settings["trades"] = found["settings"]
        if source.explanations:
            sections["Explanations"] = {f"explanation_{i:02d}_{k}": t for i, e in enumerate(source.explanations.values(), 1) for k, t in e.tables.items()}
        sections["Dates"] = {"daily": c.daily(min_count), "date_sensitivity": c.stability()}
        parts = []
        for title, tables in sections.items():
            parts.append(f"<h2>{html.escape(title)}</h2>")
            for name, t in tables.items():
                pdf = t.toPandas() if isinstance(t, DataFrame) else t
                pdf.to_csv(folder / f"{name}.csv", index=False)
                parts.append(f"<h3>{html.escape(name)}</h3>{_table(pdf)}")
        coverage = c.coverage().first().asDict()
    finally:
        if c is not source:
            c.release()
    manifest = {
        "created_utc": datetime.now(UTC), "roles": asdict(c.roles), "filters": list(c.filters), "fingerprint": source.fingerprint(), "coverage": coverage, "slices": [asdict(s) for s in specs], "interactions": [[asdict(x), asdict(y)] for x, y in pairs], "metric": metric, "min_count": min_count,
        "inference": asdict(policy), "inference_family": "the ok tests of one table; the overall test is by itself", "include_candidate": include_candidate, "candidate_population": candidate_population, "candidate_top_n": candidate_top_n, "temporal_population": temporal_population, "temporal_entity": temporal_entity,
        "available_predictions": {"columns": source.predictions, "offsets": source.offsets}, "retained_models": list(source.models), "explanations": {k: e.settings for k, e in source.explanations.items()}, "training_performed": False, **settings,
    }
    (folder / "review.json").write_text(json.dumps(plain(manifest), indent=1, allow_nan=False))
    title = html.escape(f"{c.roles.candidate_name} against {c.roles.reference_name}")
    (folder / "report.html").write_text(f"<!doctype html><meta charset=utf-8><title>{title}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}</style><h1>{title}</h1><main>" + "".join(parts) + "</main>")
    return folder


def export_walk_forward(result: WalkForwardResult, output: str, **options) -> Path:
    """export of the out-of-fold comparison, with the folds, their metrics and the out-of-fold predictions, which are
    written by Spark as a Parquet folder; the manifest and the page say so."""
    folder = export(result.comparison, output, **options)
    pd.DataFrame(result.folds).to_csv(folder / "folds.csv", index=False)
    by_fold = result.fold_metrics.orderBy("fold_id").toPandas()  # a row for each fold
    by_fold.to_csv(folder / "fold_metrics.csv", index=False)
    result.predictions.write.parquet((folder / "oof_predictions.parquet").resolve().as_uri())
    (folder / "walk_forward.json").write_text(json.dumps(plain({"folds": result.folds, **result.configuration}), indent=1, allow_nan=False))
    manifest = json.loads((folder / "review.json").read_text())
    manifest |= {"training_performed": True, "evaluation_design": "walk_forward_cross_validation", "walk_forward_configuration": "walk_forward.json", "final_holdout_evaluated": False}
    (folder / "review.json").write_text(json.dumps(manifest, indent=1, allow_nan=False))
    links = "".join(f'<li><a href="{n}">{n}</a></li>' for n in ("folds.csv", "fold_metrics.csv", "oof_predictions.parquet", "walk_forward.json"))
    section = f"<h2>Walk-forward validation</h2><p>Every row was predicted once, by models fitted on earlier dates. Pooled metrics count rows alike, this table shows the folds; no final reserve was evaluated.</p>{_table(by_fold)}<ul>{links}</ul>"
    page = folder / "report.html"
    page.write_text(page.read_text().replace("</main>", section + "</main>"))
    return folder
