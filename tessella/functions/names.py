"""Names that callers may give in more than one spelling."""

from __future__ import annotations

# The names that are known, each with its other spellings.
NAMES = {
    "event type": {"purchase": (), "engagement": (), "pageview": ("page_view",), "custom": ()},
    "window": {"minute": (), "hour": (), "day": (), "week": ()},
    "drift method": {"ks": ("kolmogorov_smirnov",), "kl": ("kullback_leibler",), "hellinger": ("hellinger_distance",), "chi_square": ("chi2",)},
    "drift severity": {"none": (), "low": (), "medium": (), "high": (), "critical": ()},
    "lifecycle stage": {"prospect": (), "onboarding": (), "active": (), "mature": (), "at_risk": ("atrisk",), "dormant": (), "churned": ()},
    "logical operator": {"AND": (), "OR": (), "NOT": ()},
}
_KNOWN = {kind: {spelling.lower(): name for name, others in names.items() for spelling in (name, *others)} for kind, names in NAMES.items()}


def known(kind: str, text: str) -> str:
    """The name that the text means, in any case; an error that lists the names if it means none."""
    found = _KNOWN[kind].get(str(text).lower())
    if found is None:
        raise ValueError(f"unknown {kind} {text!r}; there are {', '.join(NAMES[kind])}")
    return found
