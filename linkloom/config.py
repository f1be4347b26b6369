"""Thresholds and vocabularies of matching, in one place and passed as an argument."""

from __future__ import annotations

from dataclasses import dataclass

#: Colours that a read may carry.
COLORS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white", "gray", "beige", "gold", "silver", "multicolour")
#: Other words for them.
COLOR_SYNONYMS = {
    "grey": "gray",
    "multicolor": "multicolour",
    "multicolored": "multicolour",
    "multicoloured": "multicolour",
    "multi-colour": "multicolour",
    "multi-color": "multicolour",
    "cream": "beige",
    "tan": "beige",
    "navy": "blue",
    "teal": "blue",
    "maroon": "red",
    "burgundy": "red",
    "violet": "purple",
    "lilac": "purple",
}
#: Detection statuses, what they are called, and the list they are shown in.
STATUS_LABELS = {
    "auto_added": "Added",
    "needs_review": "Needs review",
    "unmatched": "No match",
    "unreadable": "Unreadable",
    "failed": "Failed",
    "confirmed": "Confirmed",
    "discarded": "Discarded",
}
ADDED = ("auto_added", "confirmed")
REVIEW = ("needs_review", "unmatched", "unreadable", "failed")


#: Weights, thresholds and limits of matching.
@dataclass(frozen=True)
class MatchConfig:
    title_weight: float = 0.75
    author_weight: float = 0.25
    no_author_cap: float = 0.85
    surname_threshold: float = 0.85
    auto_score: float = 0.90
    auto_margin: float = 0.12
    review_score: float = 0.55
    candidates: int = 3
    color_margin: float = 0.05


#: Thresholds of box cleaning and the padding of crops.
@dataclass(frozen=True)
class BoxConfig:
    kind: str = "book"
    min_conf: float = 0.25
    min_aspect: float = 2.5
    min_width_share: float = 0.015
    same_iou: float = 0.55
    same_containment: float = 0.80
    same_width_ratio: float = 0.60
    divider_share: float = 0.30
    divider_peak: float = 2.0
    padding: int = 6
    rotate_aspect: float = 1.15


MATCH = MatchConfig()
BOXES = BoxConfig()
