"""Inputs: driver tables, domain views and delimited text files."""

from churnlens.sources.tables import Tables
from churnlens.sources.warehouse import Warehouse

__all__ = ["Tables", "Warehouse"]
