from importlib import import_module

MODULES = ["text", "store", "groups", "issues", "feed", "ops", "streams"]


def load():
    """Import every query module and return the filled registry."""
    for module in MODULES:
        import_module(f"issueloom.registry.{module}")
    return import_module("issueloom.registry.base")
