"""daybook: a PySpark-native engine for personal-journal archives.

The names below are the library's surface; a module is imported when one of its names is first used.
"""

from importlib import import_module

_SURFACE = {
    "Store": "daybook.operators.store", "Conflict": "daybook.operators.store", "TABLES": "daybook.schemas", "sync": "daybook.sources.sync", "Client": "daybook.sources.paging", "Banned": "daybook.sources.paging",
    "Secret": "daybook.cli", "build": "daybook.cli", "status": "daybook.cli", "Event": "daybook.progress", "silent": "daybook.progress", "to_stderr": "daybook.progress",
    "extract": "daybook.functions.html", "render": "daybook.functions.html", "extract_udf": "daybook.functions.html", "render_column": "daybook.functions.html",
    "image_stats": "daybook.operators.assets", "host_collapse": "daybook.operators.assets", "fetch_all": "daybook.sources.fetch",
    "link_userpics": "daybook.operators.pictures", "link_posters": "daybook.operators.pictures", "register": "daybook.sql", "query": "daybook.sql",
}
__all__ = sorted(_SURFACE)


def __getattr__(name: str):
    if name in _SURFACE:
        return getattr(import_module(_SURFACE[name]), name)
    raise AttributeError(f"module 'daybook' has no attribute {name!r}")
