"""Whole jobs: several operators over one input, returned as named DataFrames."""

from tabulon.plans.catalog import CatalogColumns, catalog_report, typed_catalog
from tabulon.plans.clustering import CatalogModel, cluster_report
from tabulon.plans.output import write_reports
from tabulon.plans.telemetry import TelemetryColumns, telemetry_report

__all__ = [
    "CatalogColumns",
    "CatalogModel",
    "TelemetryColumns",
    "catalog_report",
    "cluster_report",
    "telemetry_report",
    "typed_catalog",
    "write_reports",
]
