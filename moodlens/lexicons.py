"""Indicator lexicons and tagging rules.

The lists below are FIXED VALUES that must equal the original application's
for equal results: word and emoji order, the repeated U+1F630 in the negative
list, and the variation selectors (U+FE0F) are all significant.  The local
lexicon and the stream rules differ on purpose (bare U+2665 vs U+2665 U+FE0F,
U+263A U+FE0F only locally, "terrible" only in the rules).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- FIXED VALUES: local indicator lexicon (counted by substring) ----------
POSITIVE_INDICATORS = [
    "love", "congratulations", "thank you", "exciting", "excited", "favorite",
    "fav", "amazing", "lovely", "incredible", "elated",
    "😀", "😃", "😄", "😁", "😆", "😚", "😘", "🥰", "😍", "🤩", "🥳", "🙂",
    "☺️", "😊", "😏", "😋", "😎", "❤️", "♥", "👍", "🙌",
]
NEGATIVE_INDICATORS = [
    "hate", "stop", "angry", "stupid", "horrible", "worst", "sucks", "bad",
    "disappointing",
    "😐", "😰", "😰", "😔", "☹️", "🙁", "😕", "😟", "🥺", "😢", "😥", "😓",
    "😞", "😖", "😣", "😩", "😫", "🤢", "🤮", "💔", "🖕",
]

# ---- FIXED VALUES: stream tagging rules (tag, terms, lang, excluded word) ---
POSITIVE_KEYWORDS = [
    "love", "congratulations", "thank you", "exciting", "excited", "favorite",
    "fav", "amazing", "lovely", "incredible", "elated",
]
POSITIVE_EMOJIS = [
    "😀", "😃", "😄", "😁", "😆", "😚", "😘", "🥰", "😍", "🤩", "🥳", "🙂",
    "😊", "😏", "😋", "😎", "❤️", "♥️", "👍", "🙌",
]
NEGATIVE_KEYWORDS = [
    "hate", "stop", "angry", "stupid", "horrible", "worst", "sucks", "bad",
    "disappointing", "terrible",
]
NEGATIVE_EMOJIS = [
    "😐", "😰", "😰", "😔", "☹️", "🙁", "😕", "😟", "🥺", "😢", "😥", "😓",
    "😞", "😖", "😣", "😩", "😫", "🤢", "🤮", "💔", "🖕",
]
TAG_POSITIVE_KEYWORDS = "positive keywords"
TAG_POSITIVE_EMOJIS = "positive emojis"
TAG_NEGATIVE_KEYWORDS = "negative keywords"
TAG_NEGATIVE_EMOJIS = "negative emojis"
RULE_LANG = "en"
RULE_EXCLUDE = "no"
# ---- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One tagging rule.

    ``kind`` is ``"keyword"`` (whole-token / phrase match) or ``"emoji"``
    (substring match).  ``exclude`` is a token that vetoes the rule.
    """

    rule_id: str
    tag: str
    terms: tuple[str, ...]
    kind: str
    lang: str | None = RULE_LANG
    exclude: str | None = None

    def as_row(self) -> tuple:
        return (self.rule_id, self.tag, list(self.terms), self.lang, self.exclude)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def add(self, *new: Rule) -> "RuleSet":
        known = {r.rule_id for r in self.rules}
        dup = [r.rule_id for r in new if r.rule_id in known]
        if dup:
            raise ValueError(f"rule ids already present: {dup}")
        return RuleSet(self.rules + tuple(new))

    def delete(self, *ids: str) -> "RuleSet":
        drop = set(ids)
        return RuleSet(tuple(r for r in self.rules if r.rule_id not in drop))

    def __iter__(self):
        return iter(self.rules)

    def __len__(self):
        return len(self.rules)


def default_rules() -> RuleSet:
    """The four stream rules, in file order, with ids 1..4."""
    return RuleSet((
        Rule("1", TAG_POSITIVE_KEYWORDS, tuple(POSITIVE_KEYWORDS), "keyword", exclude=RULE_EXCLUDE),
        Rule("2", TAG_POSITIVE_EMOJIS, tuple(POSITIVE_EMOJIS), "emoji"),
        Rule("3", TAG_NEGATIVE_KEYWORDS, tuple(NEGATIVE_KEYWORDS), "keyword", exclude=RULE_EXCLUDE),
        Rule("4", TAG_NEGATIVE_EMOJIS, tuple(NEGATIVE_EMOJIS), "emoji"),
    ))


def default_lexicon() -> list[tuple[int, str, str]]:
    """(position, indicator, polarity) for the local lexicon, duplicates kept."""
    return lexicon_from_lists(POSITIVE_INDICATORS, NEGATIVE_INDICATORS)


def lexicon_from_lists(positive, negative) -> list[tuple[int, str, str]]:
    rows = [(i, t, "positive") for i, t in enumerate(positive)]
    rows += [(len(positive) + i, t, "negative") for i, t in enumerate(negative)]
    return rows
