"""Filters by name: a registry with typed parameters and one way to run them over tiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from voxelloom.functions.batches import map_payloads, per_slices
from voxelloom.operators import bandpass, gauss, histogram, threshold


def _to_bool(text: str) -> bool:
    value = {"true": True, "false": False}.get(text.strip().lower())
    if value is None:
        raise ValueError(f"not a boolean: {text!r}")
    return value


PARAMETER_TYPES: dict[str, Callable] = {"boolean": _to_bool, "int": int, "double": float, "string": str}


@dataclass(frozen=True)
class Filter:
    """A kernel over uint8 arrays: (n, z, y, x) per tile or (n, y, x) per slice; shape and type are kept."""

    name: str
    kernel: Callable[..., np.ndarray]
    parameters: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    granularity: str = "tile"

    def bind(self, given: Mapping[str, object]) -> dict[str, object]:
        """Parameter values, texts being converted to the declared type."""
        unknown = set(given) - set(self.parameters)
        if unknown:
            raise ValueError(f"filter {self.name!r} has no parameter {sorted(unknown)}")
        values = dict(self.defaults)
        for key, value in given.items():
            convert = PARAMETER_TYPES[self.parameters[key]]
            values[key] = convert(value) if isinstance(value, str) else value
        missing = set(self.parameters) - set(values)
        if missing:
            raise ValueError(f"filter {self.name!r} needs {sorted(missing)}")
        return values


_REGISTRY: dict[str, Filter] = {}


def register_filter(
    name: str,
    kernel: Callable[..., np.ndarray],
    parameters: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    granularity: str = "tile",
) -> Filter:
    """Make a kernel available by name; parameter types are boolean, int, double or string."""
    if granularity not in ("tile", "slice"):
        raise ValueError("granularity is 'tile' or 'slice'")
    parameters = dict(parameters or {})
    unknown = set(parameters.values()) - set(PARAMETER_TYPES)
    if unknown:
        raise ValueError(f"unknown parameter type {sorted(unknown)}")
    spec = Filter(name, kernel, parameters, dict(defaults or {}), granularity)
    _REGISTRY[name] = spec
    return spec


def filter_named(name: str) -> Filter:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(f"no filter {name!r}; registered: {sorted(_REGISTRY)}") from None


def bound_filter(spec: str | Filter, params: Mapping[str, object] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The filter with its parameters, as a kernel over (n, z, y, x) stacks."""
    chosen = filter_named(spec) if isinstance(spec, str) else spec
    values = chosen.bind(params or {})
    kernel = chosen.kernel

    if chosen.granularity == "slice":

        def run(stack: np.ndarray) -> np.ndarray:
            return per_slices(stack, lambda slices: kernel(slices, **values))
    else:

        def run(stack: np.ndarray) -> np.ndarray:
            return kernel(stack, **values)

    return run


def apply_filter(tiles: DataFrame, spec: str | Filter, params: Mapping[str, object] | None = None) -> DataFrame:
    """Run a filter over every tile; a narrow step, whatever the filter."""
    return tiles.mapInArrow(map_payloads(bound_filter(spec, params)), tiles.schema)


def _gaussian(stack, sigma_x, sigma_y, sigma_z):
    return gauss.blur(stack, (sigma_x, sigma_y, sigma_z))


def _bandpass(slices, **settings):
    return bandpass.bandpass_slices(slices, bandpass.Band(**settings))


_SIGMAS = {"sigma_x": "double", "sigma_y": "double", "sigma_z": "double"}
register_filter("gaussian", _gaussian, _SIGMAS, {"sigma_x": 1.0, "sigma_y": 1.0, "sigma_z": 1.0})
register_filter(
    "gaussian_iso", lambda stack, sigma: gauss.blur(stack, (sigma,) * 3), {"sigma": "double"}, {"sigma": 1.0}
)
register_filter(
    "gaussian_strip", gauss.blur_strip, {"sigma_x": "double", "sigma_y": "double"}, {"sigma_x": 1.0, "sigma_y": 1.0}
)
register_filter(
    "bandpass",
    _bandpass,
    {
        "large": "double",
        "small": "double",
        "stripes": "string",
        "tolerance": "double",
        "scale": "boolean",
        "saturate": "boolean",
    },
    {"large": 40.1, "small": 3.0, "stripes": "None", "tolerance": 5.0, "scale": True, "saturate": True},
    granularity="slice",
)
register_filter(
    "threshold",
    threshold.binarise,
    {"method": "string", "dark": "boolean"},
    {"method": "Default", "dark": True},
    granularity="slice",
)
register_filter("stretch", histogram.stretch, {"saturated": "double"}, {"saturated": 1.0}, granularity="slice")
register_filter("invert", lambda stack: 255 - stack, granularity="slice")
