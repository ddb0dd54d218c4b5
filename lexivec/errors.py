"""Exceptions of the library."""


class LexivecError(Exception):
    """Base of all errors raised here."""


class InvalidArgument(LexivecError, ValueError):
    """A parameter or its combination makes no sense."""


class InvalidModel(LexivecError, ValueError):
    """A model file is broken or of another format."""


class NaNEncountered(LexivecError, ArithmeticError):
    """Training or a norm gave a value that isn't a number."""


class Aborted(LexivecError, RuntimeError):
    """Training or a search was ended before it had a result."""
