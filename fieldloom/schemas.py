"""Table schemas, value domains and declared limits."""

from __future__ import annotations

from pyspark.sql import types as T

_ID = T.LongType()
_TEXT = T.StringType()
_INT = T.IntegerType()
_TIME = T.TimestampNTZType()


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, *rest) for name, kind, *rest in columns])


USERS = _table(
    ("user_id", _ID, False), ("email", _TEXT, False), ("password_hash", _TEXT, False),
    ("status", _TEXT, False), ("created_at", _TIME), ("updated_at", _TIME),
)
ACTIVATION_CODES = _table(
    ("code_id", _ID, False), ("code", _TEXT, False), ("total_uses", _INT, False),
    ("used_count", _INT, False), ("status", _TEXT, False), ("created_at", _TIME), ("expires_at", _TIME),
)
RESUMES = _table(
    ("resume_id", _ID, False), ("user_id", _ID, False), ("title", _TEXT),
    ("fields", T.MapType(_TEXT, _TEXT), False), ("created_at", _TIME), ("updated_at", _TIME),
)
USER_ACTIVATIONS = _table(
    ("activation_id", _ID, False), ("user_id", _ID, False), ("code_id", _ID, False),
    ("remaining_uses", _INT, False), ("activated_at", _TIME),
)
USAGE_LOGS = _table(
    ("log_id", _ID, False), ("user_id", _ID, False), ("website_url", _TEXT, False),
    ("fields_count", _INT, False), ("success_count", _INT, False), ("used_at", _TIME),
)
FORM_FIELD = _table(
    ("name", _TEXT, False), ("type", _TEXT, False), ("label", _TEXT), ("placeholder", _TEXT),
    ("required", T.BooleanType()), ("options", T.ArrayType(_TEXT)), ("selector", _TEXT), ("xpath", _TEXT),
)
MATCH_REQUEST = _table(
    ("request_id", _ID, False), ("user_id", _ID, False), ("resume_id", _ID, False),
    ("form_fields", T.ArrayType(FORM_FIELD)), ("website_url", _TEXT), ("requested_at", _TIME),
)
MATCH_RESULT = _table(
    ("field_name", _TEXT, False), ("field_type", _TEXT, False), ("matched_value", _TEXT, False),
)

# Domains, limits and defaults of the data model.
USER_STATUSES = ("active", "inactive", "banned")
CODE_STATUSES = ("active", "used", "expired")
MAX_LENGTHS = {
    ("users", "email"): 255,
    ("users", "password_hash"): 255,
    ("activation_codes", "code"): 32,
    ("resumes", "title"): 200,
    ("usage_logs", "website_url"): 500,
}
USES_PER_REDEMPTION = 5
DEFAULT_BATCH_CODES = 10
DEFAULT_CODE_USES = 5
DEFAULT_CODE_DAYS = 30
CODE_LENGTH = 16
MAX_CODES_PER_BATCH = 100
MAX_FORM_FIELDS = 50
DEFAULT_PAGE_SIZE = 10
MAX_PAGE_SIZE = 100
UNKNOWN_URL = "unknown"
