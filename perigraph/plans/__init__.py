"""Whole analyses as single plans."""

from .flows import catalogue_to_graph, density_transport_ratio, transport_scale, truncation_sweep

__all__ = ["catalogue_to_graph", "density_transport_ratio", "transport_scale", "truncation_sweep"]
