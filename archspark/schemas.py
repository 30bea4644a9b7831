"""Schemas of all tables, declared once; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_ATOMS = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "tinyint": T.ByteType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType}


def _type(name: str) -> T.DataType:
    return T.ArrayType(_type(name[6:-1])) if name.startswith("array<") else _ATOMS[name]()


def _struct(spec: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session, so workers can import this module too."""
    return T.StructType([T.StructField(*(x if k == 0 else _type(x) for k, x in enumerate(part.split()))) for part in spec.split(", ")])


FILES = _struct("path string, language string, node_count int")
AST_NODES = _struct(
    "path string, node_id int, kind tinyint, name string, byte_start bigint, byte_end bigint, first_child_index bigint, child_count bigint, parent_index int"
)
RESOLVED_IMPORTS = _struct("path string, node_id int, raw_target string, target string, resolution string, candidates int")
DEPENDENCIES = _struct("source string, target string, kind string, resolution string, raw_target string")
VERTICES = _struct("path string, node_count int, class_count int, function_count int, import_count int")
EDGES = _struct("source string, target string, weight bigint, kinds array<string>")
CLASS_COHESION = _struct("path string, class_name string, method_count int, field_count int, lcom1 bigint, lcom4 int, components array<array<string>>")
VIOLATIONS = _struct("rule string, severity string, subject string, message string, measured double, threshold double")
CHUNKS = _struct("chunk_id string, path string, kind string, name string, qualified_name string, parent_class string, text string, byte_start bigint, byte_end bigint, line_start int, line_end int")
AUDIT = _struct(
    "id bigint, created_at string, target string, request string, model string, dependents array<string>, dependencies array<string>, radius_depth int, radius_truncated boolean, "
    "target_afferent int, target_efferent int, target_instability double, retrieved_chunks array<string>, excluded_chunks array<string>, prompt string, prompt_chars int, "
    "response string, input_tokens int, output_tokens int, duration_ms int, error string"
)

#: Node kinds in the order of their numbers, with their display names.
KINDS = ("File", "Class", "Function", "Import", "Call", "Variable", "Other", "FieldAccess")
FILE, CLASS, FUNCTION, IMPORT, CALL, VARIABLE, OTHER, FIELD_ACCESS = range(8)
EDGE_KINDS = ("import", "inheritance")
RESOLUTIONS = ("resolved", "ambiguous", "external")
