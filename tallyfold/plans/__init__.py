"""End-to-end plans over the given tables."""

from importlib import import_module

_MODULES = ("settle_queries", "scalar_queries", "ingest_queries", "payment_queries", "ledger_queries", "corpus_queries", "relational_queries")


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
