"""Imports every check module."""

from . import change_checks, cluster_checks, flow_checks, mining_checks, query_checks, ranking_checks, routing_checks, scalars, state_checks, store, view_checks  # noqa: F401
