"""DataFrame-to-DataFrame operators: filters, de-duplication, joins, features, reports, incremental runs."""
