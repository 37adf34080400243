"""The four failure classes a caller can tell apart."""


class PrivacyEngineError(Exception):
    """Base of every error raised on purpose by this package."""


class InvalidQuery(PrivacyEngineError):
    """The request itself is wrong: unknown column, missing bound, no budget left."""


class LibraryFailure(PrivacyEngineError):
    """A step of the computation could not be carried out."""


class AccessDenied(PrivacyEngineError):
    """The user may not read this dataset."""


class InternalFailure(PrivacyEngineError):
    """A state that should not occur; carries no private detail."""
