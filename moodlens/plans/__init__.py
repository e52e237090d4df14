"""Analyses: pure functions (posts[, users]) -> DataFrame."""

from moodlens.plans.analyses import (  # noqa: F401
    account_age_split, activity_groups, activity_split, followers_mean,
    followers_mean_of_means, hourly_polarity, polarity_totals, post_user_table,
    sample_posts, samples_as_text, verified_counts,
)
