"""Errors with stable codes."""

from __future__ import annotations

from enum import Enum

# The names of the error codes, which callers key on.
ErrorCode = Enum(
    "ErrorCode",
    "GENERAL_FAILURE MISSING_CIPHER_ALGORITHM MISSING_ASSISTED_QUERY_ALGORITHM MISSING_LIKE_QUERY_ALGORITHM MISSING_SENSITIVE_FIELD_MASKER INVALID_TABLE_RULE INVALID_FIELD_RULE "
    "SHARED_DERIVED_COLUMN_ALGORITHM_MISMATCH MISSING_STORAGE_TABLE MISSING_ASSISTED_QUERY_COLUMN MISSING_LIKE_QUERY_COLUMN CIPHER_OPERATION_FAILED ASSISTED_QUERY_OPERATION_FAILED "
    "SEPARATE_TABLE_OPERATION_FAILED SQL_REWRITE_FAILED AMBIGUOUS_ENCRYPTED_REFERENCE INVALID_ENCRYPTED_QUERY_OPERAND INVALID_ENCRYPTED_WRITE_OPERAND UNSUPPORTED_ENCRYPTED_INSERT "
    "UNSUPPORTED_ENCRYPTED_SELECT UNSUPPORTED_ENCRYPTED_IN_QUERY UNSUPPORTED_ENCRYPTED_RANGE UNSUPPORTED_ENCRYPTED_ORDER_BY UNSUPPORTED_ENCRYPTED_DISTINCT "
    "UNSUPPORTED_ENCRYPTED_AGGREGATION UNSUPPORTED_ENCRYPTED_WINDOW UNSUPPORTED_ENCRYPTED_GROUP_BY UNSUPPORTED_ENCRYPTED_OPERATION",
)
MigrationCode = Enum(
    "MigrationCode",
    "GENERAL_FAILURE DEFINITION_INVALID METADATA_RULE_MISSING FIELD_SELECTOR_UNRESOLVED BACKUP_COLUMN_CONFLICT CURSOR_COLUMN_MUTABLE TABLE_EXCLUDED CURSOR_VALUE_MISSING "
    "CHECKPOINT_LOCKED CURSOR_CHECKPOINT_INVALID RANGE_READ_FAILED EXECUTION_FAILED PLAINTEXT_UNRECOVERABLE BACKUP_VALUE_INCONSISTENT CONFIRMATION_REQUIRED "
    "CONFIRMATION_SCOPE_MISMATCH CONFIRMATION_IO_FAILED STATE_STORE_IO_FAILED STATE_STORE_DATA_INVALID STATE_INCOMPATIBLE VERIFICATION_REFERENCE_MISSING "
    "VERIFICATION_MAIN_ROW_MISSING VERIFICATION_EXTERNAL_ROW_MISSING VERIFICATION_VALUE_MISMATCH",
)


class VeilError(Exception):
    """Base of all errors; ``code`` is stable."""

    def __init__(self, code: Enum, message: str = ""):
        super().__init__(f"{code.name}: {message}" if message else code.name)
        self.code = code


class ConfigurationError(VeilError):
    """A rule or an algorithm is missing or wrong."""


class UnsupportedOperation(VeilError):
    """A statement would give a meaningless result on protected values."""


class MigrationError(VeilError):
    """A backfill can't go on."""


def unsupported(code: str, message: str = "") -> UnsupportedOperation:
    return UnsupportedOperation(ErrorCode[code], message)


def misconfigured(code: str, message: str = "") -> ConfigurationError:
    return ConfigurationError(ErrorCode[code], message)


def migration_error(code: str, message: str = "") -> MigrationError:
    return MigrationError(MigrationCode[code], message)
