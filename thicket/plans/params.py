"""Model configuration: one frozen record, validated whenever it is made."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

OBJECTIVES = (
    "reg:squarederror", "reg:logistic", "binary:logistic", "binary:logitraw", "count:poisson", "reg:gamma", "reg:tweedie", "reg:squaredlogerror", "reg:absoluteerror",
    "reg:pseudohubererror", "reg:quantileerror", "binary:hinge", "multi:softmax", "multi:softprob", "rank:ndcg", "rank:map", "rank:pairwise", "survival:cox", "survival:aft",
)
BOOSTERS = ("gbtree", "dart", "gblinear")

#: Other names of parameters.
ALIASES = {
    "learning_rate": "eta", "n_estimators": "num_trees", "num_boost_round": "num_trees", "reg_lambda": "lambda_", "lambda": "lambda_", "reg_alpha": "alpha", "min_split_loss": "gamma",
    "max_bins": "max_bin", "random_state": "seed", "colsample_by_tree": "colsample_bytree", "colsample_by_level": "colsample_bylevel", "colsample_by_node": "colsample_bynode", "booster_type": "booster",
}


class ParamError(ValueError):
    """A parameter has an unknown name or a value out of range."""


@dataclass(frozen=True)
class Params:
    objective: str = "reg:squarederror"
    booster: str = "gbtree"
    tree_method: str = "hist"
    num_trees: int = 100
    eta: float = 0.3
    max_depth: int = 6
    max_leaves: int = 0
    gamma: float = 0.0
    lambda_: float = 1.0
    alpha: float = 0.0
    min_child_weight: float = 1.0
    max_delta_step: float = 0.0
    max_bin: int = 256
    boost_from_average: bool = True
    base_score: float = 0.5
    subsample: float = 1.0
    sampling_method: str = "uniform"
    feature_weights: tuple[float, ...] = ()
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    num_class: int = 1
    num_parallel_tree: int = 1
    refresh_leaf: bool = False
    early_stopping_rounds: int = 0
    monotone: Mapping[int, int] = field(default_factory=dict)
    interactions: tuple[tuple[int, ...], ...] = ()
    categorical: tuple[int, ...] = ()
    max_cat_to_onehot: int = 4
    rate_drop: float = 0.0
    one_drop: bool = False
    skip_drop: float = 0.0
    sample_type: str = "uniform"
    normalize_type: str = "tree"
    scale_pos_weight: float = 1.0
    tweedie_variance_power: float = 1.5
    quantile_alpha: float = 0.5
    huber_slope: float = 1.0
    aft_distribution: str = "normal"
    aft_scale: float = 1.0
    ndcg_exp_gain: bool = True
    eval_metric: tuple[str, ...] = ()
    on_margin: bool = False
    seed: int = 0
    compat: bool = False
    custom_objective: Callable | None = None
    custom_metric: Callable | None = None
    callbacks: tuple[Callable, ...] = ()

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ParamError(what)

        need(self.objective in OBJECTIVES or self.custom_objective is not None, f"unknown objective {self.objective!r}")
        need(self.booster in BOOSTERS, f"unknown booster {self.booster!r}")
        need(self.tree_method in ("hist", "exact"), f"unknown tree_method {self.tree_method!r}")
        need(self.num_trees >= 1 and self.num_parallel_tree >= 1, "num_trees and num_parallel_tree are at least 1")
        need(0 < self.eta <= 1, "eta is over 0 and at most 1")
        need(self.max_depth >= 0 and self.max_leaves >= 0 and (self.max_depth or self.max_leaves), "max_depth or max_leaves is needed")
        need(min(self.gamma, self.lambda_, self.alpha, self.min_child_weight, self.max_delta_step) >= 0, "regularisation isn't negative")
        need(2 <= self.max_bin <= 2048, "max_bin is 2 to 2048")
        for name in ("subsample", "colsample_bytree", "colsample_bylevel", "colsample_bynode"):
            need(0 < getattr(self, name) <= 1, f"{name} is over 0 and at most 1")
        for name in ("rate_drop", "skip_drop"):
            need(0 <= getattr(self, name) <= 1, f"{name} is 0 to 1")
        need(self.sampling_method in ("uniform", "gradient_based"), "sampling_method is uniform or gradient_based")
        need(self.sample_type in ("uniform", "weighted") and self.normalize_type in ("tree", "forest"), "unknown dart option")
        need(1 < self.tweedie_variance_power < 2, "tweedie_variance_power is between 1 and 2")
        need(0 < self.quantile_alpha < 1, "quantile_alpha is between 0 and 1")
        need(self.huber_slope > 0 and self.scale_pos_weight > 0 and self.aft_scale > 0, "huber_slope, scale_pos_weight and aft_scale are positive")
        need(self.aft_distribution in ("normal", "logistic", "extreme"), "unknown aft_distribution")
        need(not self.objective.startswith("multi:") or self.num_class >= 2, "multi-class needs num_class of at least 2")
        need(all(v in (-1, 0, 1) for v in self.monotone.values()), "a monotone constraint is -1, 0 or 1")

    @property
    def classes(self) -> int:
        return self.num_class if self.objective.startswith("multi:") else 1

    def with_(self, **changes: Any) -> Params:
        """A changed copy; unknown names raise, aliases are understood."""
        known = {f.name: f for f in dataclasses.fields(self)}
        out = {}
        for name, value in changes.items():
            name = ALIASES.get(name, name)
            if name not in known:
                raise ParamError(f"unknown parameter {name!r}")
            old = getattr(self, name)
            if isinstance(old, bool) and not isinstance(value, bool) or isinstance(old, str) and not isinstance(value, str):
                raise ParamError(f"{name} can't be {value!r}")
            if isinstance(old, int) and not isinstance(old, bool):
                if value != int(value):
                    raise ParamError(f"{name} can't be {value!r}")
                value = int(value)
            elif isinstance(old, float):
                value = float(value)
            elif isinstance(old, tuple):
                value = tuple(value)
            out[name] = value
        return dataclasses.replace(self, **out)


def params(**values: Any) -> Params:
    return Params().with_(**values)
