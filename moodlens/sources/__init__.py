"""Readers, writers and the mapping of the driver tables onto posts/users."""

from moodlens.sources.fixtures import (  # noqa: F401
    load_tables, posts_from_documents, posts_from_events, posts_from_orders,
    users_from_customers,
)
from moodlens.sources.files import (  # noqa: F401
    authors_to_fetch, explode_envelopes, land_posts, quarantine_report, quarantine_split,
    read_posts, read_posts_with_quarantine, read_user_envelopes, read_users, register_views,
)
