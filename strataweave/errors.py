"""Errors of the engine. Uncertainty is data and never raises; inputs, contracts and budgets do."""

from __future__ import annotations

import contextlib
import re

from pyspark.errors import PySparkException


class EngineError(Exception):
    """Root of all errors."""


class InputError(EngineError):
    """The input can't be read."""


class XmlSecurityError(InputError):
    """The document breaks the loader's policy."""


class UnsafeXmlError(XmlSecurityError):
    """DOCTYPE or entity declarations, or limits of structure."""


class InvalidXmlError(InputError):
    """Not well formed."""


class InputTooLargeError(InputError):
    """The limit on bytes was passed."""


class StructureLimitError(UnsafeXmlError, InputTooLargeError):
    """A limit on depth, elements, attributes, names or expanded text was passed."""


class UnsupportedRevisionError(InputError):
    """No adapter takes the document; `revision` is the label found, if any."""

    code = "UNSUPPORTED_REVISION"

    def __init__(self, message: str, revision: str | None = None, source: str | None = None):
        super().__init__(message)
        self.revision, self.source = revision, source


class AmbiguousRevisionError(UnsupportedRevisionError):
    """Several adapters take the document."""

    code = "AMBIGUOUS_REVISION"


class AdapterRegistrationError(EngineError):
    """An adapter breaks the registry's contract."""


class SemanticError(EngineError):
    """The canonical model is used against its rules."""


class ResourceLimitError(SemanticError):
    """A budget was passed; results are never truncated."""


class ModelValidationError(SemanticError):
    """Rows of the model break an integrity rule."""


class EntitySelectionError(SemanticError):
    """A selector matches no entity, or several."""


class ReportError(EngineError):
    """A report can't be rendered or written."""


_RAISED = re.compile(r"strataweave\.errors\.([A-Za-z]+): (.*)")


@contextlib.contextmanager
def worker_errors():
    """Errors that Python workers raise come back as themselves, not wrapped in Spark's."""
    try:
        yield
    except PySparkException as e:
        found = _RAISED.search(str(e))
        kind = globals().get(found[1]) if found else None
        if isinstance(kind, type) and issubclass(kind, EngineError):
            raise kind(found[2].strip()) from None
        raise
