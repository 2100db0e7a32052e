"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, H, TS, N = T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.TimestampType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2 and f[2]) for f in fields])


#: The ordered header of a payment CSV.
PAYMENT_CSV_COLUMNS = (
    "session_key", "try_seq", "terminal_key", "merchant_key", "category_id", "category_title", "amount", "adjusted_fee",
    "session_status", "try_status", "switch_response_code", "psp_code", "issuer_bank_code", "payer_card_key", "verify_type",
    "init_time_ms", "verify_time_ms", "created_at", "try_created_at", "verified_at", "settled_at", "expire_in",
)
PAYMENT_CSV = T.StructType([T.StructField(c, S) for c in PAYMENT_CSV_COLUMNS])

#: Enumerations.
SESSION_STATUSES = ("Failed", "Paid", "Reversed", "Verified")
TRY_STATUSES = ("Failed", "InBank", "NoAttempt", "Paid", "Reversed", "Verified")
SUCCESS_STATUSES = ("Verified", "Paid")

DATASET_IMPORTS = _schema(
    ("source_filename", S), ("sha256", S), ("source_size_bytes", L), ("source_row_count", L), ("session_count", L), ("try_count", L), ("transformation_version", S), ("imported_at", TS)
)
MERCHANTS = _schema(("merchant_id", L), ("merchant_key", S))
CATEGORIES = _schema(("category_id", S), ("category_title", S))
TERMINALS = _schema(("terminal_id", L), ("merchant_id", L), ("terminal_key", S))
SESSIONS = _schema(
    ("session_id", L), ("session_key", S), ("merchant_id", L), ("terminal_id", L), ("category_id", S), ("amount", L), ("adjusted_fee", L),
    ("session_status", S), ("verify_type", S), ("created_at", N), ("expires_at", N),
)
TRIES = _schema(
    ("session_id", L), ("merchant_id", L), ("try_seq", H), ("try_status", S), ("switch_response_code", S, True), ("psp_code", S, True), ("issuer_bank_code", S, True),
    ("payer_card_key", S, True), ("init_time_ms", I, True), ("verify_time_ms", I, True), ("try_created_at", N, True), ("verified_at", N, True), ("settled_at", N, True),
)

CODE_BLOCK = T.StructType([T.StructField("lang", S), T.StructField("source", S), T.StructField("text", S)])
CHUNKS = _schema(
    ("id", S), ("path", S), ("url", S), ("anchor", S, True), ("cite_url", S), ("heading_path", T.ArrayType(S)), ("lang", S), ("text", S), ("text_norm", S),
    ("code_blocks", T.ArrayType(CODE_BLOCK)), ("token_estimate", I), ("commit", S),
)
