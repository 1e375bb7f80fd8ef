"""Errors that callers may want to tell apart."""


class TesseraError(Exception):
    """Base of all errors that this library raises on purpose."""


class ConfigError(TesseraError):
    """A setting is missing, unknown or out of range."""


class IngestionError(TesseraError):
    """A source can't be listed, fetched, decoded or parsed."""


class StoreError(TesseraError):
    """A snapshot or table is missing or inconsistent."""


class ValidationError(TesseraError):
    """A staged revision breaks an invariant."""


class EmbeddingError(TesseraError):
    """An embedder gave the wrong number of vectors, or vectors of the wrong kind."""


class RetrievalError(TesseraError):
    """A search can't be carried out as asked."""


class CitationError(TesseraError):
    """An answer cites evidence that it wasn't given."""


class RegistryError(TesseraError):
    """A component can't be resolved."""


class ConflictError(RegistryError):
    """Several components answer to one name."""


class ProtocolError(RegistryError):
    """A component lacks methods of its role, or has another interface version."""
