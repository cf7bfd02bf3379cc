"""Impact and lineage analysis over mainframe source libraries, as Spark jobs."""

from .plans.api import (
    Analyzer,
    Store,
    db2_boundary,
    field_dependencies_json,
    field_dependency_summary,
    get_field_dependencies,
    get_program_field_dependencies,
    get_table_dependencies,
    index,
    list_tables,
    query,
    table_dependencies_json,
    table_dependency_summary,
    write_report,
)
from .plans.api import list_tables as tables
from .plans.fields import FieldResult
from .plans.index import Index, open_index, stream_index, vacuum
from .plans.tables import Result

__all__ = ["Analyzer", "FieldResult", "Index", "Result", "Store", "db2_boundary", "field_dependencies_json", "field_dependency_summary", "get_field_dependencies", "get_program_field_dependencies", "get_table_dependencies", "index", "list_tables", "open_index", "query", "stream_index", "table_dependencies_json", "table_dependency_summary", "tables", "vacuum", "write_report"]
