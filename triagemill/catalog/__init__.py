"""All registered queries and their SQL counterparts."""


def _load() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def queries():
    from triagemill.catalog.base import QUERIES

    _load()
    return dict(QUERIES)


def oracles():
    from triagemill.catalog.base import ORACLES

    _load()
    return dict(ORACLES)
