"""The checked queries: each one next to the SQL that must give the same rows."""

from workload.registry import QUERIES, SQL  # noqa: F401
from workload import cleaning, experiments, features, labels, learning, sampling, selection, tables  # noqa: F401,E402
