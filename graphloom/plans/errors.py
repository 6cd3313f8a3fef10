"""Errors that a request can end with; ``code`` is the reply's code word."""

from __future__ import annotations


class RequestError(Exception):
    code = "SYSTEM"


class SyntaxFault(RequestError):
    code = "SYNTAX"


class SemanticFault(RequestError):
    code = "SEMANTICS"


class NotFound(RequestError):
    code = "EMPTY"


class TooMany(RequestError):
    code = "TOOMANY"


class AlreadyThere(RequestError):
    code = "EXISTS"


class Superseded(RequestError):
    code = "OUTDATED"


class NotYet(RequestError):
    code = "AGAIN"


class TooDear(RequestError):
    code = "COST"
