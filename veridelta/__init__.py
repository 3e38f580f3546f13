"""Paired-prediction evaluation on Spark. Names are imported when they are first used, so that Python workers load little."""

from importlib import import_module

_WHERE = {
    "operators.folds": ("TrainableModel", "plan_folds", "walk_forward"),
    "operators.models": ("Model", "linear_contributions", "permutation_importance"),
    "operators.shap": ("tree_shap",),
    "operators.trees": ("Tree", "TreeEnsemble"),
    "plans.comparison": ("Comparison", "compare_model_set", "compare_models", "compare_prediction_set", "compare_predictions", "walk_forward_compare"),
    "plans.config": ("InferenceConfig", "Roles", "Slice", "TemporalConfig", "TradeViewConfig", "WalkForwardConfig", "default_slices"),
    "plans.report": ("export", "export_walk_forward"),
    "sources.readers": ("attach_predictions", "from_long_predictions", "make_demo", "read_data"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_MODULE[name]}", __name__), name)
