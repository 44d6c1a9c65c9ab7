"""Models by name: what there is for a task, tiers of models, their grids, and what can be said of their channels."""

from __future__ import annotations

import numpy as np

# Models by task, and tiers of them. The boosting libraries' names stand for BoostedTrees here, as those libraries are not.
REGRESSION = ["PLS", "Ridge", "Lasso", "ElasticNet", "RandomForest", "MLP", "NeuralBoosted", "SVR", "XGBoost", "LightGBM", "CatBoost"]
CLASSIFICATION = ["PLS-DA", "PLS", "RandomForest", "MLP", "NeuralBoosted", "SVM", "XGBoost", "LightGBM", "CatBoost"]
WITH_IMPORTANCE = ["PLS", "PLS-DA", "Ridge", "Lasso", "ElasticNet", "RandomForest", "MLP", "NeuralBoosted", "SVR", "XGBoost", "LightGBM", "CatBoost"]
TIERS = {
    "regression": {
        "quick": ["PLS", "Ridge", "ElasticNet"],
        "standard": ["PLS", "Ridge", "Lasso", "ElasticNet", "RandomForest", "LightGBM"],
        "comprehensive": ["PLS", "Ridge", "ElasticNet", "RandomForest", "LightGBM", "XGBoost", "CatBoost", "NeuralBoosted"],
        "experimental": ["PLS", "Ridge", "Lasso", "ElasticNet", "RandomForest", "XGBoost", "LightGBM", "CatBoost", "SVR", "MLP", "NeuralBoosted"],
    },
    "classification": {
        "quick": ["PLS-DA", "LightGBM", "RandomForest"],
        "standard": ["PLS-DA", "RandomForest", "LightGBM", "XGBoost", "CatBoost"],
        "comprehensive": ["PLS-DA", "RandomForest", "LightGBM", "XGBoost", "CatBoost", "SVM", "MLP", "NeuralBoosted"],
        "experimental": ["PLS-DA", "PLS", "RandomForest", "LightGBM", "XGBoost", "CatBoost", "SVM", "MLP", "NeuralBoosted"],
    },
}
# The standard grids.
GRIDS = {
    "PLS": {"n_components": [2, 3, 4, 5, 6, 7, 8]},
    "PLS-DA": {"n_components": [2, 3, 4, 5, 6, 7, 8]},
    "Ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "ElasticNet": {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.3, 0.5, 0.7]},
    "NeuralBoosted": {"hidden": [3, 5], "activation": ["tanh", "identity"]},
    "RandomForest": {"n": [100], "depth": [30]},
    "BoostedTrees": {"n": [100, 200], "rate": [0.05, 0.1], "depth": [3, 6]},
    "SVR": {"kernel": ["rbf", "linear"], "c": [1.0, 10.0]},
    "SVM": {"kernel": ["rbf", "linear"], "c": [1.0, 10.0]},
    "MLP": {"hidden": [[64], [128, 64]]},
}
STANDS_IN = dict.fromkeys(("XGBoost", "LightGBM", "CatBoost"), "BoostedTrees")


def own_name(model: str) -> str:
    """The model that is fitted under a name."""
    return STANDS_IN.get(model, model)


def supported(task: str = "regression") -> list[str]:
    if task not in TIERS:
        raise ValueError(f"unknown task {task}: regression or classification")
    return list(REGRESSION if task == "regression" else CLASSIFICATION)


def is_valid(model: str, task: str | None = None) -> bool:
    return model in (supported(task) if task else REGRESSION + CLASSIFICATION)


def has_importances(model: str) -> bool:
    return model in WITH_IMPORTANCE or model == "BoostedTrees"


#: Channels are chosen by importance, so what has importances takes subsets.
takes_subsets = has_importances


def tier_models(tier: str = "standard", task: str = "regression") -> list[str]:
    if tier not in TIERS[task]:
        raise ValueError(f"unknown tier {tier}: one of {list(TIERS[task])}")
    return list(TIERS[task][tier])


def grid(model: str, most_components: int | None = None) -> dict[str, list]:
    """Parameters and their values; components up to most_components."""
    found = {k: list(v) for k, v in GRIDS[own_name(model)].items()}
    if most_components is not None and "n_components" in found:
        found["n_components"] = [n for n in found["n_components"] if n <= most_components]
    return found


def importances(fitted) -> np.ndarray:
    """A non-negative weight for each channel that a fitted model of any kind here saw: PLS by VIP, linear models by coefficients, kernel machines by
    dual weights times their samples, trees by gain, networks by first-layer weights; several one-against-rest models by their mean."""
    if hasattr(fitted, "models"):
        return np.mean([importances(m) for m in fitted.models], axis=0)
    if hasattr(fitted, "pls"):
        return fitted.pls.vip()
    if hasattr(fitted, "vip"):
        return fitted.vip() if fitted.t.size else np.zeros(len(fitted.x_mean))
    if hasattr(fitted, "importances"):
        return fitted.importances()
    if hasattr(fitted, "coef"):
        return np.abs(fitted.coef)
    if hasattr(fitted, "b"):
        return np.abs(fitted.b) @ np.abs(fitted.x)
    raise ValueError(f"{type(fitted).__name__} says nothing of its channels")
