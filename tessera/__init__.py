"""A versioned, fragment-based columnar table engine on Spark.

Every function takes the session first and returns DataFrames, handles or what was committed.
"""

from tessera.operators.compact import CompactionMetrics, compact_files
from tessera.operators.evolve import add_columns
from tessera.operators.scalar_index import IndexConfig, create_scalar_index
from tessera.operators.search import full_text_search, nearest
from tessera.operators.vector_index import create_index
from tessera.plans.compaction import CompactionOptions
from tessera.sources.fragments import FRAGMENT_SCHEMA, FragmentWriter, commit_fragments
from tessera.sources.reader import read_table
from tessera.sources.writer import write_table
from tessera.table import Table

__all__ = [
    "FRAGMENT_SCHEMA", "CompactionMetrics", "CompactionOptions", "FragmentWriter", "IndexConfig", "Table", "add_columns", "commit_fragments", "compact_files",
    "create_index", "create_scalar_index", "full_text_search", "nearest", "read_table", "write_table",
]
