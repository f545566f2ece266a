from . import aggregates, gates, joins, ledgers, matching, names, packages, review, rules, scalars, scans, stories, streams, verdicts, vocabularies, webpages, windows  # noqa: F401  each registers its queries
