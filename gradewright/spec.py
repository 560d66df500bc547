"""Task specifications: roles, predicates, phases and a success conjunction. They are checked when built, on the driver, and
compiled to Column expressions by `gradewright.operators.episode`; nothing about a task is a constant of the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright.errors import SpecError
from gradewright.operators.predicates import BINARY, TAU
from gradewright.sources.store import digest

MOTIONS = ("co_moves_with_effector", "static", "actuated", "free")
SCHEMA_VERSION = 1
#: Characters that YAML readers fold or refuse: control characters but line feed and tab, and the two Unicode separators. The same in Java and RE2.
HOSTILE = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{2028}\x{2029}]"


def clean(text: str) -> str:
    bad = next((c for c in text if c in "\u2028\u2029" or (unicodedata.category(c) == "Cc" and c not in "\n\t")), None)
    if bad is not None:
        raise SpecError(f"{bad!r} may not stand in the text of a specification: it would not survive YAML")
    return text


def hostile(c: Column) -> Column:
    """Whether a text column holds a character that `clean` refuses."""
    return c.rlike(HOSTILE)


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            for text in value if isinstance(value, tuple) else (value,):
                if isinstance(text, str):
                    clean(text)


@dataclass(frozen=True)
class Role(_Checked):
    name: str
    definition: str = ""
    motion: str = "free"
    candidates: tuple[str, ...] = ()
    required: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.motion not in MOTIONS:
            raise SpecError(f"role {self.name!r}: {self.motion!r} is no motion; motions are {', '.join(MOTIONS)}")


@dataclass(frozen=True)
class Predicate(_Checked):
    kind: str
    subject: str
    object: str | None = None
    params: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.kind not in TAU:
            raise SpecError(f"unknown predicate kind {self.kind!r}; kinds are {', '.join(sorted(TAU))}")
        if self.kind in BINARY and self.object is None:
            raise SpecError(f"{self.kind}({self.subject}) needs an object role")

    def describe(self) -> str:
        return f"{self.kind}({self.subject}{f', {self.object}' if self.object else ''})"


@dataclass(frozen=True)
class Phase(_Checked):
    name: str
    description: str = ""
    order: int = 0
    active: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class FailureMode(_Checked):
    name: str
    description: str = ""
    signature: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class SelfTest:
    """What the compiler found when it tried a specification on its own demos and on negatives minted from them."""

    ran: bool = False
    demos_passed: int = 0
    demos_total: int = 0
    negatives_failed: int = 0
    negatives_total: int = 0
    accepted: bool = False
    notes: str = ""


@dataclass(frozen=True)
class Origin:
    demo_digests: tuple[str, ...] = ()
    compiler: str = "handwritten"
    self_test: SelfTest = field(default_factory=SelfTest)


@dataclass(frozen=True)
class TaskSpec(_Checked):
    name: str
    prompt: str
    roles: tuple[Role, ...]
    phases: tuple[Phase, ...] = ()
    success: tuple[Predicate, ...] = ()
    failure_modes: tuple[FailureMode, ...] = ()
    success_sustain_frames: int = 3
    tl_formula: str = ""
    version: int = 1
    schema_version: int = SCHEMA_VERSION
    spec_provenance: Origin = field(default_factory=Origin)

    def role(self, name: str) -> Role:
        found = next((r for r in self.roles if r.name == name), None)
        if found is None:
            raise SpecError(f"specification {self.name!r} has no role {name!r}")
        return found

    def role_names(self) -> tuple[str, ...]:
        return tuple(r.name for r in self.roles)

    def ordered_phases(self) -> tuple[Phase, ...]:
        """By `order`; phases of one order keep their places."""
        return tuple(sorted(self.phases, key=lambda p: p.order))

    def to_dict(self) -> dict:
        return _plain(asdict(self))

    def content_hash(self) -> str:
        """Of everything that has a meaning for grading: where a specification came from is left out."""
        return digest({k: v for k, v in self.to_dict().items() if k != "spec_provenance"})

    def to_yaml(self) -> str:
        from gradewright.sources.files import spec_text

        return spec_text(self.to_dict())

    def with_tolerance(self, factor: float) -> TaskSpec:
        """The success conjunction with every tol_rel of a co_located times factor."""
        scaled = tuple(replace(p, params={**p.params, "tol_rel": p.params["tol_rel"] * factor}) if p.kind == "co_located" and "tol_rel" in p.params else p for p in self.success)
        return replace(self, success=scaled)


def _plain(x):
    if isinstance(x, Mapping):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


_NESTED = {"roles": Role, "phases": Phase, "success": Predicate, "failure_modes": FailureMode, "active": Predicate, "signature": Predicate}
_SINGLE = {"spec_provenance": Origin, "self_test": SelfTest}


def _built(cls: type, data: Mapping):
    if not isinstance(data, Mapping):
        raise SpecError(f"{cls.__name__}: a mapping is needed, not {type(data).__name__}")
    extra = sorted(set(data) - {f.name for f in fields(cls)})
    if extra:
        raise SpecError(f"{cls.__name__}: unknown keys {', '.join(extra)}")
    values = {}
    for k, v in data.items():
        if k in _NESTED:
            v = tuple(_built(_NESTED[k], x) for x in v or ())
        elif k in _SINGLE:
            v = _built(_SINGLE[k], v)
        elif isinstance(v, list):
            v = tuple(v)
        elif k == "params":
            v = {name: float(x) for name, x in v.items()}
        values[k] = v
    try:
        return cls(**values)
    except TypeError as error:
        raise SpecError(f"{cls.__name__}: {error}") from error


def spec_from_dict(data: Mapping, steps: Mapping[int, Callable[[dict], dict]] | None = None) -> TaskSpec:
    """A specification of any known schema version: `steps` maps a version to the function that makes it the next one."""
    data, steps = dict(data), steps or {}
    while (version := int(data.get("schema_version", 1))) < SCHEMA_VERSION:
        if version not in steps:
            raise SpecError(f"no step from schema_version {version} of a specification")
        data = dict(steps[version](data))
        if int(data.get("schema_version", 1)) != version + 1:
            raise SpecError(f"the step from schema_version {version} must lead to {version + 1}")
    if version > SCHEMA_VERSION:
        raise SpecError(f"a specification of schema_version {version}: only up to {SCHEMA_VERSION} is known")
    return _built(TaskSpec, data)


def spec_from_yaml(text: str) -> TaskSpec:
    from gradewright.sources.files import spec as mapping

    return spec_from_dict(mapping(text))


def transport_phases(subject: str = "carried_object", target: str = "receptacle") -> tuple[Phase, ...]:
    """The phases of a task that carries one thing to another."""
    return (Phase("approach", "the subject comes nearer to the target", 0, (Predicate("approaching", subject, target),)),
            Phase("arrive", "the subject reaches the target", 1, (Predicate("co_located", subject, target, {"tol_rel": 2.5}),)),
            Phase("settle", "the subject rests there", 2, (Predicate("stationary", subject),)))


def insertion_spec() -> TaskSpec:
    """The reference task of the synthetic world: a block is put into a cup. Names and numbers are fixed values."""
    block, cup, hand = "carried_object", "receptacle", "gripper"
    inside = Predicate("contained", block, cup)
    return TaskSpec(
        name="synthetic-insert", prompt="put the red block into the green cup",
        roles=(Role(block, "moves with the effector and is left behind", "co_moves_with_effector", ("red block", "red square")),
               Role(cup, "stands still; the block ends inside it", "static", ("green cup", "green container")),
               Role(hand, "carries the block", "actuated", ("blue gripper", "blue dot"), False)),
        phases=(Phase("approach", "the block comes nearer to the cup", 0, (Predicate("approaching", block, cup),)),
                Phase("insert", "the block is in the cup", 1, (inside,)),
                Phase("settle", "the block rests in the cup", 2, (Predicate("stationary", block),))),
        success=(replace(inside, params={"erode_px": 5.0}), Predicate("stationary", block, None, {"tol": 1.5})),
        failure_modes=(FailureMode("missed", "the block ends beside the cup"), FailureMode("dropped", "the block is lost on its way")),
        success_sustain_frames=5)
