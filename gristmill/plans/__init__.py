"""Named queries over the driver's tables."""

from gristmill.plans import catalog, corpus, reports

__all__ = ["catalog", "corpus", "reports"]
