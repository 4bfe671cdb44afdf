"""All registered queries."""

from molspark.catalog import awkward, base, flows, joins, metrics, scans, selection, splits, tokens, tuning  # noqa: F401
