"""Strategies by name: ``module:attribute``, called with the configuration given for it."""

from __future__ import annotations

from importlib import import_module


def strategy(path: str, **config):
    """What ``path`` names, bound to ``config``; ValueError if it names nothing that can be called."""
    module, _, name = path.partition(":")
    if not module or not name:
        raise ValueError(f"not module:attribute: {path!r}")
    try:
        found = import_module(module)
        for part in name.split("."):
            found = getattr(found, part)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"{path!r} names nothing") from e
    if not callable(found):
        raise ValueError(f"{path!r} can't be called")
    return lambda *args, **more: found(*args, **{**config, **more})
