"""Named DataFrame transforms, chosen by side, kind and split."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]
SIDES = ("source", "target")
KINDS = ("feature", "waveform")


class TransformRegistry:
    """Transforms by name, to be listed in a data configuration."""

    def __init__(self) -> None:
        self._by_name: dict[str, Transform] = {}

    def register(self, name: str) -> Callable[[Transform], Transform]:
        def add(fn: Transform) -> Transform:
            if name in self._by_name:
                raise ValueError(f"transform {name!r} is taken")
            self._by_name[name] = fn
            return fn

        return add

    def apply(self, df: DataFrame, config: Mapping, side: str, split: str, train: bool, kind: str = "feature") -> DataFrame:
        """Apply the configured transforms one after another."""
        for name in chosen(config, side, split, train, kind):
            df = df.transform(self._by_name[name])
        return df


def _listed(config: Mapping, key: str, split: str, train: bool) -> list[str] | None:
    by_split = config.get(key, {})
    for name in (split, "_train" if train else "_eval", "*"):
        if by_split.get(name) is not None:
            return list(by_split[name])
    return None


def chosen(config: Mapping, side: str, split: str, train: bool, kind: str = "feature") -> list[str]:
    """Names of the transforms in force.

    ``<side>_<kind>_transforms`` maps a split, else ``_train``/``_eval``, else ``*`` to names. The
    older ``<side>_transforms`` holds feature transforms and goes first.
    """
    if side not in SIDES or kind not in KINDS:
        raise ValueError(f"no transforms for {side} {kind}")
    names = _listed(config, f"{side}_{kind}_transforms", split, train) or []
    if kind == "feature":
        names = (_listed(config, f"{side}_transforms", split, train) or []) + names
    return names
