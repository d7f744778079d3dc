"""Errors of the engine; all derive from ``EngineError``."""


class EngineError(Exception):
    pass


class TransactionIsReadOnlyException(EngineError):
    pass


class TransactionLockAcquisitionException(EngineError):
    pass


class CommitException(EngineError):
    pass


class StoreNotFoundException(EngineError):
    pass


class StoreAlreadyExistsException(EngineError):
    pass


class ManifestException(EngineError):
    pass


class WriteAheadLogCorruptedException(EngineError):
    pass


class TruncatedInputException(EngineError):
    pass


class FileMissingException(EngineError):
    pass


class FlushException(EngineError):
    pass


class BlockReadException(EngineError):
    pass


class CursorException(EngineError):
    """Carries every error that close handlers raised."""

    def __init__(self, errors: list[BaseException]):
        super().__init__("; ".join(map(str, errors)))
        self.errors = errors
