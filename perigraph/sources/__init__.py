"""Readers and writers for the files that point-set and diffusion studies exchange."""

from .arrays import read_array, read_bundle, read_points, read_sparse_matrix, remove_unfinished, write_array, write_bundle, write_points, write_sparse_matrix
from .documents import first_path, read_document, write_document
from .files import checked_write, discover_tables, file_digests, read_commented_table, read_probe_directory, write_csv

__all__ = ["checked_write", "discover_tables", "file_digests", "first_path", "read_array", "read_bundle", "read_commented_table", "read_document", "read_points", "read_probe_directory", "read_sparse_matrix", "remove_unfinished", "write_array", "write_bundle", "write_csv", "write_document", "write_points", "write_sparse_matrix"]
