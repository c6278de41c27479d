"""All registered hazard-analytics queries and their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil

from .. import plans

QUERIES: dict = {}
ORACLES: dict = {}
for _found in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name != "registry"):
    _module = importlib.import_module(f"{plans.__name__}.{_found}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

FLAGSHIP = QUERIES["noisy_or_risk"]
