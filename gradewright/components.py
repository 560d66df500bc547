"""Components by kind and name. A component is a class whose instances map DataFrames to DataFrames, so Catalyst sees through it.

grounder: rollouts -> bindings and tracks. gate_signal: tracks -> (rollout_id, signal, status, value).
channel: tracks -> (rollout_id, channel, status, value), its `caps` on the class. judge: (images, prompt) -> replies.
"""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field, replace
from importlib import metadata

from gradewright.errors import PluginError

KINDS = ("grounder", "gate_signal", "channel", "judge")
GROUP, DISABLE = "gradewright.components", "GRADEWRIGHT_NO_PLUGINS"
_found: dict[tuple[str, str], type] = {}


def register(kind: str, name: str):
    """Class decorator. The same class may come again; another under the same name is an error."""
    if kind not in KINDS:
        raise PluginError(f"{kind!r} is no kind of component; kinds are {', '.join(KINDS)}")

    def put(cls: type) -> type:
        held = _found.setdefault((kind, name), cls)
        if held is not cls:
            raise PluginError(f"{kind} {name!r} is {held.__module__}.{held.__qualname__} already")
        return cls

    return put


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _found if k == kind)


def find(kind: str, name: str) -> type:
    if (kind, name) not in _found:
        raise PluginError(f"there is no {kind} {name!r}; known: {', '.join(names(kind)) or 'none'}")
    return _found[kind, name]


def load_plugins() -> list[str]:
    """Import the entry points of GROUP, unless DISABLE is 1; a broken one is warned of and skipped. Returns the broken ones."""
    broken = []
    if os.environ.get(DISABLE) != "1":
        for point in metadata.entry_points(group=GROUP):
            try:
                point.load()
            except Exception as error:  # any third-party failure: reported, not fatal
                warnings.warn(f"component {point.name} failed to load: {error}", stacklevel=2)
                broken.append(point.name)
    return broken


@dataclass(frozen=True)
class RunConfig:
    """A template of a run; `with_changes` copies, so explicit choices win and the template stays."""

    grounder: str = ""
    signals: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    params: dict[str, dict] = field(default_factory=dict)

    def with_changes(self, **changes) -> RunConfig:
        copied = {k: dict(v) for k, v in self.params.items()}
        return replace(self, **({"params": copied} | changes))
