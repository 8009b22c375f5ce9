"""What a request can be answered with instead of rows. Nothing is clamped or answered in part: it is refused."""

from __future__ import annotations


class EngineError(Exception):
    status = 500


class Refused(EngineError):
    """The request is malformed, or asks for more than a limit allows."""

    status = 400


class Forbidden(Refused):
    """The collection is the engine's own."""

    status = 403


class NotFound(EngineError):
    status = 404


class Conflict(EngineError):
    """An index is redefined, or a cursor belongs to another layout."""

    status = 409


class Gone(EngineError):
    """A change position below the floor; the stream can resume at ``resume_floor``."""

    status = 410

    def __init__(self, message: str, resume_floor: int):
        super().__init__(message)
        self.resume_floor = resume_floor


class PreconditionFailed(EngineError):
    """``etag`` is the document's current version, None if there is no document."""

    status = 412

    def __init__(self, message: str, etag: str | None):
        super().__init__(message)
        self.etag = etag
