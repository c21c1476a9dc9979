"""Fixed vocabularies used by cleaning and type detection.

FIXED VALUES: these word lists must stay exactly as written for results to
agree with the matching system this library reproduces. They are data, not
logic; keep them in this order and spelling.
"""

# FIXED VALUES: spellings treated as a missing cell (compared after lower-casing,
# before any stripping).
NULL_SPELLINGS = (
    "not allowed to collect",
    "not reported",
    "unknown",
    "not otherwise specified",
    "nos",
    "not applicable",
    "na",
    "not available",
    "n/a",
    "none",
    "null",
    "",
    " ",
    "missing",
    "unspecified",
    "undetermined",
    "not collected",
    "not recorded",
    "not provided",
    "no data",
    "unavailable",
    "empty",
    "undefined",
    "not defined",
    "other, specify",
    "other",
    "exposure to secondhand smoke history not available",
    "exposure to secondhand smoke history not available.",
    "indeterminate",
    "staging incomplete",
    "no pathologic evidence of distant metastasis",
    "medical record does not state",
    "patient not interviewed",
    "medical record does not state.",
    "patient not interviewed.",
)

# FIXED VALUES: a column whose lower-cased name starts or ends with one of these
# is a key column.
KEY_AFFIXES = (
    "id",
    "identifier",
    "key",
    "uuid",
    "gid",
    "sid",
    "token",
    "serial",
    "code",
    "hash",
    "primary_key",
    "foreign_key",
    "access_key",
    "unique_id",
    "slug",
    "auth_token",
    "apikey",
    "object_id",
    "record_id",
)

# FIXED VALUES: words that make a two-valued column binary.
BINARY_WORDS = (
    "yes",
    "no",
    "true",
    "false",
    "t",
    "f",
    "y",
    "n",
    "1",
    "0",
    "1.0",
    "0.0",
    "1.00",
    "0.00",
    "0.",
    "1.",
    "present",
    "absent",
    "positive",
    "negative",
    "detected",
    "not detected",
    "normal",
    "abnormal",
    "enabled",
    "disabled",
    "active",
    "inactive",
    "open",
    "closed",
    "success",
    "failure",
    "on",
    "off",
    "approved",
    "rejected",
    "included",
    "excluded",
    "passed",
    "failed",
    "accepted",
    "denied",
    "smoker",
    "non-smoker",
    "not identified",
    "no or minimal exposure to secondhand smoke",
    "no or minimal exposure to secondhand smoke.",
)

# FIXED VALUES: golden-ratio fraction used by the fibonacci hash.
PHI_FRACTION = 0.6180339887

# Date layouts accepted by our date test, as (Spark pattern, strftime pattern) pairs.
# Cleaned cells carry spaces where the raw text had separators, so both shapes occur.
DATE_FORMATS = (
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("yyyy MM dd", "%Y %m %d"),
    ("yyyy MM dd HH mm ss", "%Y %m %d %H %M %S"),
    ("yyyy MM dd HH mm ss SSSSSS", "%Y %m %d %H %M %S %f"),
)
