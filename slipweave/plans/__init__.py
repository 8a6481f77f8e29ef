"""Named queries over the test tables, grouped by subject."""
from importlib import import_module

MODULES = ["slip_fields", "slip_reports", "file_sets", "series_windows", "page_layout", "records", "live"]


def load() -> None:
    import pkgutil
    present = {m.name for m in pkgutil.iter_modules(__path__)}
    for m in MODULES:
        if m in present:
            import_module(f"slipweave.plans.{m}")
