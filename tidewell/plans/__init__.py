from tidewell.plans.registry import ORACLES, QUERIES


def queries():
    _load()
    return QUERIES


def oracle_sql():
    _load()
    return ORACLES


def _load():
    from tidewell.plans import aggregates, audits, context, evaluation, joins, records, scans, selections, splits, statistics, texts, windows  # noqa: F401
