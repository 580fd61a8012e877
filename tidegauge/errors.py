"""Exceptions, and the codes that bulk scans put into a column instead of raising."""


class SignalError(Exception):
    """Base of all errors of this library."""

    code = "signal"


class UnsupportedFormat(SignalError):
    code = "unsupported_format"


class DecodingError(SignalError):
    code = "decoding"


class MemoryLimitError(SignalError):
    code = "memory"


class FileAccessError(SignalError):
    code = "file_access"


class NotFound(SignalError):
    code = "not_found"


class CorruptedFile(SignalError):
    code = "corrupted"


class InvalidSignal(SignalError):
    code = "invalid_waveform"


class ConfigurationError(SignalError, ValueError):
    code = "configuration"


class StreamingError(SignalError):
    code = "streaming"


class ContainerError(SignalError):
    code = "container"


class CodecError(ContainerError):
    code = "codec"


class TrackError(ContainerError):
    code = "track"


class Cancelled(SignalError):
    code = "cancelled"


class Disposed(SignalError):
    code = "disposed"


BY_CODE = {c.code: c for c in (UnsupportedFormat, DecodingError, MemoryLimitError, FileAccessError, NotFound, CorruptedFile, InvalidSignal, ConfigurationError, StreamingError, ContainerError, CodecError, TrackError, Cancelled, Disposed)}


def from_code(code: str, message: str = "") -> SignalError:
    """The exception of a code; an unknown code gives the base class."""
    return BY_CODE.get(code, SignalError)(message or code)
