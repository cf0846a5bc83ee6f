"""Named queries; importing the package registers all of them."""

from . import ledger, pages, registry, sheets, stored, wagers

__all__ = ["ledger", "pages", "registry", "sheets", "stored", "wagers"]
