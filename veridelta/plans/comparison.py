"""The comparison: roles applied to a table, and every evidence table as a lazy DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text_time_kinds
from ..operators import diagnostics, figures, filters, folds, inference, metrics, models, prepare, shap, temporal, trades
from ..sources.tables import discard, written
from .config import Explanation, InferenceConfig, Roles, Slice, TemporalConfig, TradeViewConfig, WalkForwardConfig, default_slices


@dataclass(frozen=True)
class Comparison:
    """Immutable: filter() and select_models() give new ones on the same source."""

    data: DataFrame
    roles: Roles
    filters: tuple = ()
    predictions: dict = field(default_factory=dict)  # display name -> column
    offsets: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)  # display name -> fitted Model
    explanations: dict = field(default_factory=dict)
    prepared: DataFrame | None = None  # the evaluation rows, where prepare() has written them
    written_at: str | None = None
    position_column: str | None = None

    # rows
    @property
    def base(self) -> DataFrame:
        return prepare.base_rows(self.data, self.roles) if self.prepared is None else self.prepared

    def prepare(self, columns: list[str] | None = None) -> Comparison:
        """The same with its evaluation rows written once: all tables, and those of its filters, are read from there, and
        nothing that the source is made of runs again. columns: what is kept beside the roles' columns (all by default).
        The files live until release(), or until the shared folder is cleared."""
        if self.prepared is not None:
            return self
        base = prepare.base_rows(self.data, self.roles)
        kept = set(self.data.columns) if columns is None else {c for c in [*columns, self.position_column, *self.predictions.values(), *self.offsets.values(), *[v for k, v in asdict(self.roles).items() if k in prepare.ROLE_COLUMNS]] if c}
        table = written(base.select(*[F.col(f"`{c}`") for c in base.columns if c.startswith("__") or c in kept]), "comparison")
        return replace(self, data=table.select(*[F.col(f"`{c}`") for c in table.columns if not c.startswith("__")]), prepared=table, written_at=table.written_at)

    def release(self) -> None:
        """Deletes what prepare() wrote; tables not yet read, and other comparisons made of this one, are lost."""
        if self.written_at:
            discard(self.data.sparkSession, self.written_at)

    @property
    def rows(self) -> DataFrame:
        return self.base.where(prepare.PAIRED)

    @property
    def candidate_rows(self) -> DataFrame:
        return self.base.where(prepare.CANDIDATE)

    def _population(self, name: str) -> DataFrame:
        if name not in ("candidate", "paired"):
            raise ValueError("population must be candidate or paired")
        return self.candidate_rows if name == "candidate" else self.rows

    @property
    def _key(self) -> list:
        return prepare.order_key(self.base, self.roles)

    def _options(self, min_count: int) -> dict:
        return {"tolerance": self.roles.tolerance, "min_count": min_count}

    # paired tables
    def coverage(self) -> DataFrame:
        return prepare.coverage(self.base)

    def missingness(self) -> DataFrame:
        return prepare.missingness(self.data)

    def summary(self, min_count: int = 30) -> DataFrame:
        return metrics.metrics(self.rows, **self._options(min_count))

    def slice(self, column: str | Slice, bins: tuple | None = None, labels: tuple | None = None, *, min_count: int = 30, top_n: int = 20, right: bool = True) -> DataFrame:
        return metrics.slice_metrics(self.rows, metrics.as_slice(column, bins=bins, labels=labels, top_n=top_n, right=right), **self._options(min_count))

    def cross_slice(self, x: str | Slice, y: str | Slice, *, x_bins: tuple | None = None, y_bins: tuple | None = None, min_count: int = 30, top_n: int = 12, x_right: bool = True, y_right: bool = True) -> DataFrame:
        return metrics.cross_metrics(self.rows, metrics.as_slice(x, bins=x_bins, top_n=top_n, right=x_right), metrics.as_slice(y, bins=y_bins, top_n=top_n, right=y_right), **self._options(min_count))

    def daily(self, min_count: int = 30) -> DataFrame:
        return metrics.daily(self.rows, **self._options(min_count))

    def stability(self) -> DataFrame:
        return metrics.date_sensitivity(self.rows)

    def cases(self, limit: int = 20, order: str = "harm") -> DataFrame:
        return metrics.cases(self.rows, self._key, limit, order)

    # inference
    def paired_test(self, config: InferenceConfig | None = None, min_count: int = 30) -> DataFrame:
        return inference.paired_tests(self.rows, [], (config or InferenceConfig()).resolved(self.roles), min_count)

    def slice_test(self, spec: str | Slice, config: InferenceConfig | None = None, min_count: int = 30) -> DataFrame:
        rows = metrics.with_label(self.rows, metrics.as_slice(spec))
        return inference.paired_tests(rows, ["group"], (config or InferenceConfig()).resolved(self.roles), min_count)

    def cross_slice_test(self, x: str | Slice, y: str | Slice, config: InferenceConfig | None = None, min_count: int = 30) -> DataFrame:
        a, b = metrics.as_slice(x), metrics.as_slice(y)
        if a.column == b.column:
            raise ValueError("the two slices need two columns")
        rows = metrics.with_label(metrics.with_label(self.rows, a, "__x"), b, "__y")
        return inference.paired_tests(rows, ["__x", "__y"], (config or InferenceConfig()).resolved(self.roles), min_count).withColumnsRenamed({"__x": "x", "__y": "y"})

    # candidate tables
    def candidate_diagnostics(self, slices: list | None = None, *, population: str = "candidate", min_count: int = 30, top_n: int = 20, bins: int = 10) -> dict[str, DataFrame]:
        rows, options = self._population(population), self._options(min_count)
        specs = [metrics.as_slice(s) for s in (default_slices(self.roles) if slices is None else slices)]
        named = [*([self.roles.id_column] if self.roles.id_column else []), *([self.position_column] if self.position_column else []), *[s.column for s in specs]]
        out = {
            "summary": diagnostics.summary(rows, **options).withColumn("population", F.lit(population)), "calibration": diagnostics.calibration(rows, bins), "residual_quantiles": diagnostics.residual_quantiles(rows),
            "worst_cases": diagnostics.worst_cases(rows, self._key, named, top_n), "daily": diagnostics.candidate_daily(rows, **options),
        }
        return out | ({"worst_slices": diagnostics.worst_slices(rows, specs, top_n=top_n, **options)} if specs else {})

    def temporal_diagnostics(self, config: TemporalConfig | None = None, *, population: str = "candidate", entity: object = None) -> dict:
        config, rows = config or TemporalConfig(), self._population(population)
        if entity is not None:
            rows = rows.where(F.col("__entity") == F.lit(entity))
        series = temporal.clock_series(rows, config)
        spectrum, context = temporal.spectrum(series, config)
        changes = temporal.mean_shifts(series, config)
        summary = temporal.temporal_summary(rows, series, config, context, changes.count())
        summary |= {"population": population, "entity_filter": entity, "entities_in_population": rows.select("__entity").where("__entity IS NOT NULL").distinct().count()}
        lags, events = temporal.autocorrelation(series, config), temporal.event_lags(rows, config.max_lag, config.signal)
        return {"summary": summary, "series": series, "autocorrelation": lags, "spectrum": spectrum, "change_points": changes, "event_lags": events, "guide": temporal.reading_guide(summary, lags, events)}

    def trade_diagnostics(self, config: TradeViewConfig | None = None) -> dict:
        config = config or TradeViewConfig()
        rows = trades.focused(self.rows, self.roles, config)
        frequency, dates, span = trades.auto_frequency(rows, config.frequency)
        placed = trades.view_coordinates(rows, config, self.roles.error_scale)
        points, bins = trades.sampled_points(placed, self._key, config), trades.intraday(rows, self.roles, config, frequency)
        audit = trades.view_audit(self.rows, placed, points, bins, self.roles, config) | {"frequency": frequency, "local_dates": dates, "calendar_span_days": span}
        return {"summary": audit, "intraday": bins, "points": points, "settings": asdict(config)}

    # tables behind the figures
    def grid(self, x: str | Slice, y: str | Slice, value: str = "mae_delta", **options) -> DataFrame:
        """One of cross_slice's columns as a grid."""
        return figures.label_grid(self.cross_slice(x, y, **options), value)

    def significance_grid(self, x: str | Slice, y: str | Slice, value: str = "t_statistic", config: InferenceConfig | None = None, min_count: int = 30) -> DataFrame:
        return figures.label_grid(self.cross_slice_test(x, y, config, min_count), value)

    def figure_tables(self, *, population: str = "candidate", bins: int = 10) -> dict[str, DataFrame]:
        """Histogram, calibration, normal quantiles and, where rows have ids, evenly spaced points of the candidate's errors."""
        rows = self._population(population)
        out = {"histogram": figures.histogram(rows, "__error_candidate"), "calibration": diagnostics.calibration(rows, bins), "normal_quantiles": figures.normal_quantiles(rows, "__error_candidate")}
        if self.roles.id_column:
            out["points"] = figures.even_points(rows, [self.roles.id_column], ["__candidate", "__error_candidate", "__ae_candidate"])
        return out

    # populations and models
    def with_positions(self, name: str = "source_position") -> Comparison:
        """The same with each source row's place in the order of its id, from 0, as a column: it stays a row's own through
        filters and other pairs, and cases, worst cases and explanations carry it."""
        if not self.roles.id_column:
            raise ValueError("map the id column first")
        if name in self.data.columns:
            raise ValueError(f"data has a column {name} already")
        placed = temporal.numbered(self.data, [self.roles.id_column], name)
        return replace(self, data=placed, prepared=None, position_column=name, explanations={})

    def worst_keys(self, model: str | None = None, *, population: str = "paired", limit: int = 20) -> list:
        """The ids of the rows that a model's saved predictions miss most, for shap_values(keys=...): limit at most."""
        name = model or self.roles.candidate_name
        if name not in self.predictions or not self.roles.id_column:
            raise ValueError("name one of the predictions, and map the id column")
        c = self if name == self.roles.candidate_name else self.select_models(self.roles.candidate_name, name)
        rows = c.candidate_rows if population == "candidate" else c.rows
        return [r[0] for r in rows.orderBy(F.desc("__ae_candidate"), *c._key).limit(limit).select(F.col(f"`{self.roles.id_column}`")).collect()]

    def filter(self, column: str, **options) -> Comparison:
        """Fewer rows of the source; conditions add up, explanations of the larger population go."""
        keep = self.data.where(filters.condition(self.data, column, **options))
        ready = None if self.prepared is None else self.prepared.where(filters.condition(self.data, column, **options))
        return replace(self, data=keep, prepared=ready, filters=(*self.filters, {"column": column, **options}), explanations={})

    def select_models(self, reference: str, candidate: str) -> Comparison:
        """Another pair of the columns that were given or scored; nothing is predicted again."""
        if missing := {reference, candidate} - set(self.predictions):
            raise ValueError(f"no such models: {sorted(missing)}")
        roles = replace(self.roles, reference=self.predictions[reference], candidate=self.predictions[candidate], reference_name=reference, candidate_name=candidate, reference_offset=self.offsets.get(reference), candidate_offset=self.offsets.get(candidate))
        return replace(self, roles=roles, explanations={}, prepared=None)

    def _explained(self, name: str | None) -> tuple[str, models.Model]:
        name = name or self.roles.candidate_name
        if name not in self.models:
            raise ValueError(f"no fitted model {name!r}")
        return name, self.models[name]

    def _fitted_rows(self, model: str | None, population: str) -> tuple[str, models.Model, DataFrame]:
        name, fitted = self._explained(model)
        if not self.roles.id_column:
            raise ValueError("map the id column first")
        if fitted.offset != self.offsets.get(name, fitted.offset):
            raise ValueError(f"{name}: the model's offset isn't the comparison's")
        return name, fitted, self._population(population)

    def _explains(self, kind: str, name: str, out: Explanation, population: str) -> Explanation:
        """Tables with a row's id get its place in the source, too; the settings say what was explained."""
        key, place = self.roles.id_column, self.position_column
        if place:
            places = self.data.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{place}`"))
            out.tables = {n: t.join(places, F.col(f"`{key}`").eqNullSafe(F.col("__id"))).drop("__id") if key in t.columns else t for n, t in out.tables.items()}
        out.settings |= {"population": population, "filters": list(self.filters), "unit": self.roles.unit, "record_id_column": key}
        self.explanations[f"{kind}:{name}"] = out
        return out

    def permutation_importance(self, model: str | None = None, *, population: str = "paired", **options) -> Explanation:
        """On the comparison's own rows; the model must still give the predictions that were compared."""
        name, fitted, rows = self._fitted_rows(model, population)
        out = models.permutation_importance(rows, self.roles.actual, fitted, key=self.roles.id_column, error_scale=self.roles.error_scale, **options)
        return self._explains("permutation", name, out, population)

    def shap_values(self, model: str | None = None, *, population: str = "candidate", **options) -> Explanation:
        """TreeSHAP of a fitted model of this comparison, on its own rows."""
        name, fitted, rows = self._fitted_rows(model, population)
        out = shap.tree_shap(rows, fitted, key=self.roles.id_column, actual=self.roles.actual, error_scale=self.roles.error_scale, **options)
        return self._explains("shap", name, out, population)

    def fingerprint(self) -> str:
        """SHA-256 of the schema and an order-free sum of row hashes: it does not depend on row order or partitioning."""
        columns = [F.col(f"`{c}`") for c in self.data.columns]
        n, total = self.data.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        return hashlib.sha256(f"{self.data.schema.simpleString()}|{n}|{total}".encode()).hexdigest()


def compare_predictions(data: DataFrame, actual: str, reference: str, candidate: str, *, check: bool = True, **roles) -> Comparison:
    r = Roles(actual, reference, candidate, **roles)
    if r.id_column and check:
        from ..sources.readers import check_key

        check_key(data, [r.id_column], "data")
    if r.time_column and check and dict(data.dtypes).get(r.time_column) == "string":
        zoned, local = (F.count_if(x) for x in text_time_kinds(r.time_column))
        if all(data.agg(zoned, local).first()):
            raise ValueError(f"{r.time_column} mixes times with a zone and local times")
    names = {r.reference_name: reference, r.candidate_name: candidate}
    return Comparison(data, r, predictions=names, offsets={r.reference_name: r.reference_offset, r.candidate_name: r.candidate_offset})


def compare_prediction_set(data: DataFrame, actual: str, predictions: dict[str, str], *, reference: str | None = None, candidate: str | None = None, prediction_offsets: dict[str, str] | None = None, **roles) -> Comparison:
    """Two or more named prediction columns; the first two are the pair unless others are named."""
    if len(predictions) < 2:
        raise ValueError("give at least two predictions")
    names, offsets = list(predictions), prediction_offsets or {}
    if bad := set(offsets) - set(names):
        raise ValueError(f"offsets of unknown predictions: {sorted(bad)}")
    reference = reference or names[0]
    candidate = candidate or next(n for n in names if n != reference)
    start = compare_predictions(data, actual, predictions[reference], predictions[candidate], reference_name=reference, candidate_name=candidate, reference_offset=offsets.get(reference), candidate_offset=offsets.get(candidate), **roles)
    return replace(start, predictions=dict(predictions), offsets=dict(offsets))


def compare_model_set(data: DataFrame, actual: str, fitted: list[models.Model], **options) -> Comparison:
    """Two or more fitted models. Their predictions are written: each model sees each row once, whatever is read later."""
    scored, columns = models.score_models(data, fitted)
    scored = written(scored, "scored")
    out = compare_prediction_set(scored, actual, {m.name: c for m, c in zip(fitted, columns, strict=True)}, **options)
    return replace(out, models={m.name: m for m in fitted})


def compare_models(data: DataFrame, actual: str, reference: models.Model, candidate: models.Model, **options) -> Comparison:
    return compare_model_set(data, actual, [reference, candidate], **options)


def walk_forward_compare(data: DataFrame, target: str, reference: folds.TrainableModel, candidate: folds.TrainableModel, *, time_column: str, settings: WalkForwardConfig | None = None, actual: str | None = None, id_column: str | None = None, entity_column: str | None = None, timezone: str = "UTC", error_scale: float = 1.0, unit: str = "target units", tolerance: float = 1.0, min_count: int = 30, progress: Callable[[dict], None] | None = None) -> folds.WalkForwardResult:
    """Fits two models anew for every fold and compares their out-of-fold predictions, pooled and by fold.

    Pooled metrics count rows alike; fold_metrics is a row for each fold, from one pass, with its training and validation
    rows. actual may be a level that the offsets restore from predicted changes; it is the target unless given."""
    settings = settings or WalkForwardConfig()
    if id_column:
        from ..sources.readers import check_key

        check_key(data, [id_column], "data")
    out, plan = folds.walk_forward(data, target, time_column, [reference, candidate], settings, zone=timezone, actual=actual, progress=progress)
    roles = {"reference_name": reference.name, "candidate_name": candidate.name, "id_column": id_column, "time_column": time_column, "entity_column": entity_column, "timezone": timezone, "error_scale": error_scale, "unit": unit, "tolerance": tolerance, "reference_offset": reference.offset, "candidate_offset": candidate.offset}
    c = compare_predictions(out, actual or target, "cv_1", "cv_2", check=False, **roles)
    counts = data.sparkSession.createDataFrame([(f["fold"], f["train_rows"], f["validation_rows"]) for f in plan], "fold_id int, train_finite_target_rows long, validation_input_rows long")
    by_fold = metrics.metrics(c.rows, ["cv_fold"], tolerance=tolerance, min_count=min_count)
    by_fold = counts.join(by_fold, F.col("fold_id") == F.col("cv_fold"), "left").drop("cv_fold").withColumns({"n": F.coalesce("n", F.lit(0)), "low_support": F.coalesce("low_support", F.lit(True))})
    rows, scored = data.count(), sum(f["validation_rows"] for f in plan)
    about = lambda m: {"name": m.name, "features": list(m.features), "offset": m.offset, "factory": getattr(m.factory, "__qualname__", type(m.factory).__qualname__), "transformer": m.transformer_factory is not None}
    configuration = {
        "settings": asdict(settings), "target": target, "actual": actual or target, "time_column": time_column, "timezone": timezone, "reference": about(reference), "candidate": about(candidate), "input_rows": rows, "oof_rows": scored, "unscored_rows": rows - scored,
        "folds": len(plan), "final_holdout_evaluated": False, "labels_assumed_available_at_record_time": settings.label_available_column is None,
        "note": "rows before the first fold, in gaps, after the last whole fold and in the reserve are not scored",
    }
    return folds.WalkForwardResult(c, out, plan, by_fold.select("fold_id", "train_finite_target_rows", "validation_input_rows", *metrics.METRICS), configuration)
