"""Exceptions; all derive from RuntimeError so callers can catch one type."""


class WaveError(RuntimeError):
    """Any failure of a waveform query."""


class MissingEndDefinitions(WaveError):
    def __init__(self) -> None:
        super().__init__("the header has no $enddefinitions")


class DuplicateSignal(WaveError):
    def __init__(self, name: str) -> None:
        super().__init__(f"a signal is declared twice: {name}")


class MissingSignals(WaveError):
    def __init__(self, names: list[str]) -> None:
        super().__init__(f"no such signals: {', '.join(names)}")


class MissingSignal(WaveError):
    def __init__(self, name: str) -> None:
        super().__init__(f"no such signal: {name}")


class InvalidOccurrence(WaveError):
    def __init__(self) -> None:
        super().__init__("occurrences are counted from 1")


class ParseError(WaveError):
    def __init__(self, what: str) -> None:
        super().__init__(f"unexpected parse error: {what}")
