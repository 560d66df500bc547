"""Errors of the engine. Missing evidence is never one of them: it is a value."""


class EngineError(Exception):
    """Base of all; a retry helps only where `retryable`."""

    retryable = False


class InfraError(EngineError):
    """Files, network, time-outs."""

    retryable = True


class SpecError(EngineError):
    """A task specification, record or label that can't be understood."""


class PluginError(EngineError):
    """An unknown or doubly registered component."""


class StoreError(EngineError):
    """A key or entry of the content store."""


class MissingDependency(InfraError):
    """An optional package is absent."""

    retryable = False

    def __init__(self, package: str, extra: str) -> None:
        super().__init__(f"{package} is not installed: install the extra '{extra}'")
        self.package, self.extra = package, extra
