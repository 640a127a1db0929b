"""Errors by what went wrong."""


class MillraceError(Exception):
    """Base of all errors that a user can act on."""


class ConfigurationError(MillraceError): ...


class CatalogError(MillraceError): ...


class SchemaVersionError(CatalogError): ...


class ArchiveError(MillraceError): ...


class LayoutError(ArchiveError): ...


class ReadError(ArchiveError): ...


class MetadataError(MillraceError): ...


class ManifestError(MillraceError): ...


class ModelError(MillraceError): ...


class ModelOutputError(ModelError): ...


class SearchError(MillraceError): ...
