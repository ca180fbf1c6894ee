"""Things that a Python worker makes once and keeps for its later tasks."""

from __future__ import annotations

import sys
import types


def kept(key: tuple, make):
    """What ``make`` gave for this key before in this process; of keys that begin alike only the last is kept.

    Held apart from this module, whose functions travel by value and are made anew in each task.
    """
    store = sys.modules.setdefault("foliotab_kept_by_worker", types.ModuleType("foliotab_kept_by_worker")).__dict__
    if store.get(key[0], (None,))[0] != key:
        store[key[0]] = (key, make())
    return store[key[0]][1]
