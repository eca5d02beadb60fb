"""Errors that graph calls raise."""


class HypergraphError(Exception):
    """Base class."""


class NotBuiltError(HypergraphError):
    """The call needs the reverse index; call ``build()`` first."""


class VertexNotFoundError(HypergraphError):
    pass


class HyperedgeNotFoundError(HypergraphError):
    pass


class CycleDetectedError(HypergraphError):
    pass


class NoPathError(HypergraphError):
    pass


class IndexOutOfBoundsError(HypergraphError):
    pass


class NotEnoughVerticesError(HypergraphError):
    pass


class NotEnoughHyperedgesError(HypergraphError):
    pass


class InvalidMagicNumberError(HypergraphError):
    pass


class UnsupportedVersionError(HypergraphError):
    pass
