"""Exceptions, raised when a plan is built wherever the fault is known by then."""


class EngineError(Exception):
    """Any fault of this engine."""


class GateError(EngineError):
    """A gate that is not valid, missing, cyclic, or has the wrong number of operands."""


class FormatError(EngineError):
    """A file or text that is not in its format."""


class QcError(EngineError):
    """Input that quality control can't work on."""


class ChannelError(EngineError):
    """A channel that is missing, present already, or of the wrong length."""
