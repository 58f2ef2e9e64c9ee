"""All queries of the library's own operators."""

from __future__ import annotations

from . import attribution, checks, detection, evaluation, full, gating, inference, studies, transferred

MODULES = (detection, attribution, inference, studies, evaluation, gating, transferred, checks)
QUERIES = {name: f for m in (*MODULES, full) for name, f in m.QUERIES.items()}
ORACLE = {name: text for m in MODULES for name, text in m.ORACLE.items()}
