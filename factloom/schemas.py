"""Schemas of the fact tables, one place for all of them. Addresses are unsigned 32-bit values and so are LONG."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# fixed values: column names and types of the fact tables
_DDL = {
    "functions": "source STRING, addr LONG, name STRING, size LONG, is_thunk BOOLEAN, is_external BOOLEAN, num_params INT, has_varargs BOOLEAN, calling_convention STRING, basic_block_count INT, signature STRING, body_hash STRING, extracted_at TIMESTAMP",
    "calls": "source STRING, caller_addr LONG, call_site_addr LONG, callee_addr LONG, ref_type STRING, is_computed BOOLEAN, is_conditional BOOLEAN, extracted_at TIMESTAMP",
    "basic_blocks": "source STRING, function_addr LONG, block_addr LONG, block_size LONG, instruction_count INT, extracted_at TIMESTAMP",
    "xrefs": "source STRING, function_addr LONG, from_addr LONG, to_addr LONG, ref_type STRING, is_primary BOOLEAN, extracted_at TIMESTAMP",
    "strings": "source STRING, addr LONG, value STRING, length INT, data_type STRING, extracted_at TIMESTAMP",
    "pcode_features": "source STRING, addr LONG, pcode_ops_total INT, pcode_unique_opcodes INT, pcode_histogram STRING, pcode_sequence_hash STRING, extracted_at TIMESTAMP",
    "mmio_events": "source STRING, scenario STRING, sequence_idx LONG, pc LONG, address LONG, value LONG, direction STRING, peripheral STRING, extracted_at TIMESTAMP",
    "decompiled": "source STRING, addr LONG, name STRING, decompiled_c STRING, decompile_success BOOLEAN, extracted_at TIMESTAMP",
    "recovered_calls": "source STRING, caller_addr LONG, callee_addr LONG, call_site_addr LONG, mechanism STRING, confidence DOUBLE, detail STRING, extracted_at TIMESTAMP",
    "peripheral_xrefs": "source STRING, function_addr LONG, from_addr LONG, access_addr LONG, ref_type STRING, peripheral STRING, register_name STRING, peripheral_group STRING, extracted_at TIMESTAMP",
    "ground_truth_functions": "source STRING, addr LONG, size LONG, name STRING, bind STRING, extracted_at TIMESTAMP",
    "unicorn_smoke": "source STRING, addr LONG, name STRING, size LONG, has_prologue BOOLEAN, prologue_type STRING, instructions_executed LONG, executable BOOLEAN, error STRING, classification STRING, veneer_target LONG, periph_write_count LONG, periph_read_count LONG, extracted_at TIMESTAMP",
    "vector_table": "source STRING, index INT, addr LONG, handler_name STRING, is_standard BOOLEAN, matched_function BOOLEAN, current_name STRING",
    "evidence_log": "id LONG, task_id LONG, target STRING, entity_addr LONG, agent_id STRING, claim_type STRING, claim_json STRING, confidence DOUBLE, evidence_method STRING, round INT, supersedes_id LONG, created_at TIMESTAMP",
    "contracts": "id LONG, source STRING, addr_start LONG, addr_end LONG, name STRING, kind STRING, claim STRING, spec STRING, provenance STRING, confidence DOUBLE, verified BOOLEAN, evidence STRING, supersedes LONG, created_at TIMESTAMP",
}
# end of fixed values

_KINDS = {"STRING": StringType(), "LONG": LongType(), "INT": IntegerType(), "DOUBLE": DoubleType(), "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType()}

TABLES: dict[str, StructType] = {table: StructType([StructField(*(name, _KINDS[kind])) for name, kind in map(str.split, columns.split(","))]) for table, columns in _DDL.items()}

#: Integer columns that a record must have.
REQUIRED = {
    "functions": ["addr"],
    "calls": ["caller_addr", "call_site_addr"],
    "basic_blocks": ["block_addr", "block_size"],
    "xrefs": ["function_addr", "from_addr"],
    "strings": ["addr"],
    "pcode_features": ["addr"],
    "mmio_events": ["sequence_idx", "address", "value"],
    "decompiled": ["addr"],
    "recovered_calls": ["callee_addr"],
    "peripheral_xrefs": ["function_addr", "from_addr", "access_addr"],
    "ground_truth_functions": ["addr"],
}
#: Columns filled in when a record leaves them out.
DEFAULTS = {"functions": {"name": ""}, "strings": {"value": ""}, "decompiled": {"name": ""}, "recovered_calls": {"confidence": 0.5, "detail": ""}, "peripheral_xrefs": {"register_name": ""}}
