"""Errors of the engine, each with the status that a service would answer with."""


class RequestError(ValueError):
    """The request itself is wrong."""

    status = 400


class NotFound(KeyError):
    status = 404

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class Conflict(RuntimeError):
    """What is to be made exists, or another writer was first."""

    status = 409
