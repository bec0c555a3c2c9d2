"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from palimpsest.llm import p1_scans, p2_personal, p3_addresses, p4_lookalike, p5_names, p6_language, p7_encode, p8_mixture, p9_spans

_MODULES = (p1_scans, p2_personal, p3_addresses, p4_lookalike, p5_names, p6_language, p7_encode, p8_mixture, p9_spans)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in _MODULES for k, s in getattr(m, "ORACLE", {}).items()}
