"""The registered queries: each operator over whole tables, with its SQL twin."""

from importlib import import_module

MODULES = ("text_queries", "state_queries", "page_queries", "vector_queries", "dedup_queries", "image_queries", "split_queries", "stream_queries", "time_queries")


def load():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    from .registry import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
