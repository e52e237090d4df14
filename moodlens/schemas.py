"""Fixed schemas: posts, users, user envelopes, rules, results.

Reading JSON with these schemas (instead of inferring) keeps every read a
single pass, makes an empty batch an empty DataFrame rather than an error, and
lets Catalyst prune nested fields.
"""

from pyspark.sql import types as T

RULE_MATCH = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("tag", T.StringType()),
])

POST_DATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
])

POST = T.StructType([
    T.StructField("data", POST_DATA),
    T.StructField("matching_rules", T.ArrayType(RULE_MATCH)),
])

PUBLIC_METRICS = T.StructType([
    T.StructField("followers_count", T.LongType()),
])

USER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("public_metrics", PUBLIC_METRICS),
])

# One look-up response: {"data": [user, user, ...]}
ENVELOPE = T.StructType([
    T.StructField("data", T.ArrayType(USER)),
])

RULE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("lang", T.StringType()),
    T.StructField("exclude", T.StringType()),
])

CORRUPT_COLUMN = "_corrupt_record"

POST_WITH_CORRUPT = T.StructType(POST.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())])
