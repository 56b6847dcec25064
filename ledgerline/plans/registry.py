
from __future__ import annotations

from ledgerline.plans import imports, labelling, maintenance, model_q, oracle, outputs, reports, sources_q


def registered_queries() -> dict:
    out = {}
    out.update(reports.QUERIES)
    out.update(labelling.QUERIES)
    out.update(imports.QUERIES)
    out.update(maintenance.QUERIES)
    out.update(sources_q.QUERIES)
    out.update(outputs.QUERIES)
    out.update(model_q.QUERIES)
    return out


def oracle_statements() -> dict:
    out = dict(oracle.ORACLE)
    return {k: v for k, v in out.items() if k in registered_queries()}
