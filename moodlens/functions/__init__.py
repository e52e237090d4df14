"""Column-level helpers (pure ``pyspark.sql.functions`` expressions)."""

from moodlens.functions.polarity import (  # noqa: F401
    CONTAINS, PREFIX, TAG, first_tag, flag, hour_utc, is_negative, is_positive, no_rules,
    rule_matches, tag_col,
)
from moodlens.functions.text import (  # noqa: F401
    has_non_ascii, lower_text, tokens, token_text,
)
