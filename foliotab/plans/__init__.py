"""Registered queries, one module per family of operators."""

import importlib
import pkgutil


def load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
