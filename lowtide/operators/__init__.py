"""DataFrame-level operators: indicators, screens, merges, joins, reports, quality."""
