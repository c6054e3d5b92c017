"""Transform chains by name, as a client would send them: [{"type": "tlag", "args": [10]}]."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from ..operators import fourier, knn, mice, missing, network, pointwise, runs, spatial, temporal, temporal_tree
from ..panel import Panel

TRANSFORMS: dict[str, Callable[..., Panel]] = {
    "identity": pointwise.identity,
    "greater_or_equal": pointwise.greater_or_equal,
    "smaller_or_equal": pointwise.smaller_or_equal,
    "in_range": pointwise.in_range,
    "ln": pointwise.ln,
    "decay": pointwise.decay,
    "add_column": pointwise.add_column,
    "subtract_column": pointwise.subtract_column,
    "multiply_column": pointwise.multiply_column,
    "divide_column": pointwise.divide_column,
    "tlag": temporal.tlag,
    "tlead": temporal.tlead,
    "delta": temporal.delta,
    "moving_average": temporal.moving_average,
    "moving_sum": temporal.moving_sum,
    "rollmax": temporal.rollmax,
    "mean": temporal.mean,
    "demean": temporal.demean,
    "tlags": temporal.tlags,
    "temporal_entropy": temporal.temporal_entropy,
    "onset_possible": temporal.onset_possible,
    "onset": temporal.onset,
    "cweq": runs.cweq,
    "time_since": runs.time_since,
    "tick_time_since": runs.tick_time_since,
    "replace_na": missing.replace_na,
    "fill_groups_with_time_means": missing.fill_groups_with_time_means,
    "fill_with_group_and_global_means": missing.fill_with_group_and_global_means,
    "extrapolate": missing.extrapolate,
    "fill": missing.fill,
    "impute": mice.impute,
    "grid_convolution": spatial.grid_convolution,
    "country_lag": network.country_lag,
    "quadtree_lag": spatial.quadtree_lag,
    "adaptive_grid_lag": spatial.adaptive_grid_lag,
    "temporal_tree_lag": temporal_tree.temporal_tree_lag,
    "spacetime_distances": knn.spacetime_distances,
    "fourier_lag": fourier.fourier_lag,
}


def apply_transforms(panel: Panel, transforms: Sequence[dict[str, Any]]) -> Panel:
    """Each transform on the result of the one before; one plan for the whole chain."""
    for t in transforms:
        if t["type"] not in TRANSFORMS:
            raise ValueError(f"no transform is named {t['type']!r}")
        panel = TRANSFORMS[t["type"]](panel, *t.get("args", ()), **t.get("kwargs", {}))
    return panel
