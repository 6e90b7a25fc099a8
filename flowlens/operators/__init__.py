"""DataFrame operators: features, joins, alert analytics, sampling, evaluation, models."""
