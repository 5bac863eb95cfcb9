"""Errors that callers tell apart, by the step that fails."""


class QuireError(Exception):
    """Any error of this package."""


class CompileError(QuireError):
    """A template or a text's YAML can't be read."""


class RegistryError(QuireError):
    """A model can't be made, registered or found."""


class FieldEditError(QuireError):
    """A field can't be changed so."""


class RoundTripError(QuireError):
    """A document isn't what its model renders."""


class CatalogError(QuireError):
    """A catalog is missing, locked or has no such document."""
