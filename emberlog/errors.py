"""Exceptions of the engine, with the stable numeric codes that callers of the key/value API rely on."""

from __future__ import annotations

# Result codes of the key/value API.
CODES = {"success": 1, "generic": 0, "db_not_found": -1, "invalid_path": -2, "io": -3, "serialization": -4, "key_not_found": -5, "type_mismatch": -6, "empty_key": -7, "key_too_long": -8, "internal_panic": -100}


class StoreError(Exception):
    """Base of all engine errors; ``code`` is the numeric result code."""

    kind = "generic"

    @property
    def code(self) -> int:
        return CODES[self.kind]


class StoreNotFound(StoreError):
    kind = "db_not_found"


class InvalidPath(StoreError):
    kind = "invalid_path"


class KeyNotFound(StoreError):
    kind = "key_not_found"


class TypeMismatch(StoreError):
    kind = "type_mismatch"


class EmptyKey(StoreError):
    kind = "empty_key"


class KeyTooLong(StoreError):
    kind = "key_too_long"


class SerializationError(StoreError):
    kind = "serialization"


class ChecksumMismatch(StoreError):
    """Stored bytes do not have the checksum that was recorded for them."""


class RunEnded(StoreError):
    """A run that has ended takes no more parameters or metrics."""


class DimensionMismatch(StoreError):
    """A vector's length is not the store's."""


class IndexNotReady(StoreError):
    """An index is used before it was fitted."""
