"""Named queries; importing the modules registers them."""

from . import activity, analysis, assistant, backoffice, catalog, changes, documents, matching, parsing, review, streams  # noqa: F401
