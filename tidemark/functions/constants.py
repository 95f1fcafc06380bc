"""Names that clients of a database ask for and that mean nothing to Spark: each gives a fixed value.

One table per value, as a client only looks whether the call succeeds; arguments are taken and ignored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

ZERO = "ts_rank ts_rank_cd inet_client_port inet_server_port pg_notification_queue_usage pg_wal_lsn_diff pg_stat_get_numscans pg_stat_get_tuples_returned pg_stat_get_tuples_fetched pg_stat_get_tuples_inserted pg_stat_get_tuples_updated pg_stat_get_tuples_deleted pg_stat_get_live_tuples pg_stat_get_dead_tuples pg_stat_get_blocks_fetched pg_stat_get_blocks_hit txid_current txid_snapshot_xmin txid_snapshot_xmax xmin xmax pg_my_temp_schema pg_trigger_depth pg_is_in_recovery pg_is_wal_replay_paused pg_is_other_temp_schema pg_backend_pid extract_timezone_hour extract_timezone_minute is_dst pg_database_size pg_tablespace_size pg_table_size pg_indexes_size pg_total_relation_size pg_relation_size database_size table_size system_memory"
ONE = "pg_has_role pg_try_advisory_lock pg_advisory_unlock pg_advisory_lock pg_try_advisory_xact_lock pg_advisory_xact_lock pg_advisory_unlock_all has_any_column_privilege has_column_privilege has_database_privilege has_function_privilege has_schema_privilege has_sequence_privilege has_server_privilege has_type_privilege has_tablespace_privilege has_language_privilege has_foreign_data_wrapper_privilege has_table_privilege pg_table_is_visible pg_type_is_visible pg_function_is_visible pg_operator_is_visible pg_opclass_is_visible pg_opfamily_is_visible pg_conversion_is_visible pg_ts_config_is_visible pg_ts_dict_is_visible pg_ts_parser_is_visible pg_ts_template_is_visible pg_collation_is_visible"
NOTHING = "pg_get_viewdef pg_get_indexdef pg_get_triggerdef pg_get_ruledef pg_get_functiondef pg_get_function_arguments pg_get_function_result pg_get_function_identity_arguments pg_get_serial_sequence pg_describe_object pg_identify_object pg_identify_object_as_address pg_get_constraintdef obj_description col_description pg_sleep"
EMPTY = "inet_client_addr inet_server_addr pg_listening_channels pg_last_wal_receive_lsn pg_last_wal_replay_lsn pg_current_wal_lsn pg_current_wal_insert_lsn pg_current_wal_flush_lsn txid_current_snapshot ctid wal_tables wal_status index_info"
ROLES = "current_role session_user pg_get_userbyid"
CLOCKS = "clock_timestamp statement_timestamp transaction_timestamp pg_postmaster_start_time pg_conf_load_time pg_last_xact_replay_timestamp"

#: Type numbers of the wire protocol.
TYPE_NAMES = {16: "boolean", 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 700: "real", 701: "double precision", 1043: "character varying", 1114: "timestamp without time zone", 1184: "timestamp with time zone"}


def _format_type(oid, _modifier=None):
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, oid.cast("int")), F.lit("unknown"))


def _fixed(value):
    return lambda *_: F.lit(value)


FUNCTIONS = {
    **{name: _fixed(0) for name in ZERO.split()},
    **{name: _fixed(1) for name in ONE.split()},
    **{name: _fixed(None) for name in NOTHING.split()},
    **{name: _fixed("") for name in EMPTY.split()},
    **{name: lambda *_: F.current_user() for name in ROLES.split()},
    **{name: lambda *_: F.current_timestamp() for name in CLOCKS.split()},
    "timeofday": lambda: F.current_timestamp().cast("string"),
    "current_catalog": lambda: F.current_catalog(),
    "current_database": lambda: F.current_catalog(),
    "server_version": lambda: F.version(),
    "server_version_num": lambda: F.regexp_replace(F.substring_index(F.version(), " ", 1), r"\D", "").cast("int"),
    "pg_catalog_version": lambda: F.version(),
    "server_info": lambda: F.version(),
    "pg_client_encoding": _fixed("UTF8"),
    "pg_encoding_to_char": lambda n: F.when(n == 6, "UTF8").when(n == 0, "SQL_ASCII").otherwise(""),
    "pg_char_to_encoding": lambda s: F.when(F.upper(s).isin("UTF8", "UTF-8"), 6).when(F.upper(s) == "SQL_ASCII", 0).otherwise(-1),
    "format_type": _format_type,
    "pg_get_expr": lambda x, *_: x,
    "convert": lambda x, *_: x,
    "convert_from": lambda x, code="UTF-8": F.decode(x.cast("binary"), code) if isinstance(code, str) else F.call_function("decode", x.cast("binary"), code),
    "convert_to": lambda x, code="UTF-8": F.encode(x, code) if isinstance(code, str) else F.call_function("encode", x, code),
    "pg_column_size": lambda x: F.octet_length(x.cast("string")),
    "table_name": lambda *_: F.input_file_name(),
}
