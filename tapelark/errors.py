"""One hierarchy of errors; each has the code it is reported under and the exit status of the command line."""

from __future__ import annotations


class TapeError(Exception):
    code, status = "E02", 2

    def __str__(self) -> str:
        return f"{self.code}: {super().__str__()}"


class BadInput(TapeError):
    """Malformed query, configuration or file."""


class AlreadyThere(TapeError):
    code, status = "E03", 3


class BadAddress(TapeError):
    code, status = "E04", 4


class OtherCheckpoint(BadAddress):
    """A watch file that belongs to another model or checkpoint."""


class TooLarge(TapeError):
    """An estimate in the red band that nobody forced."""

    code, status = "E05", 5


class NotFound(TapeError):
    code, status = "E06", 6


class SealBroken(TapeError):
    code, status = "E07", 7


class SealBrokenWarning(UserWarning):
    """A frame was made from a run whose seal does not hold."""
