from checks import aggregates, jobs, joins, scalars, scans, sequences  # noqa: F401
