"""Settings of a harvest run."""

from __future__ import annotations

from dataclasses import dataclass

BLOG = 2
PRODUCT = 3
PRODUCT_LIST = 3
PRODUCT_DETAIL = 31

# A link that contains one of these is not followed. ".jpeg" is not in the list.
DENY_EXTENSIONS = (".jpg", ".png", ".gif", ".gpeg", ".bmp", ".tiff", ".pcx", ".tga")
DENY_HOSTS = ("facebook.com", "google.com", "twitter.com")

# What makes a URL an archive or listing page.
LISTING_MARKS = (
    "?showComment", "/page/", "?=p", "?cat=", "?=page", "_archive", "#", "/search?",
    "search/label", "index.", "?paged=", "/category/",
)
LISTING_MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
LISTING_DATE = r"\d{4}[-/](?:0?[1-9]|1[012])(?:[-/](?:0?[1-9]|[12]\d|3[01]))?[-/]?$"


@dataclass(frozen=True)
class HarvestConfig:
    """Limits and switches of one harvest. ``depth_limit=None`` walks until nothing new is found."""

    kind: str = "blog"
    init_level: int = 0
    depth_limit: int | None = None
    scope: str = "prefix"
    deny_extensions: tuple[str, ...] = DENY_EXTENSIONS
    deny_hosts: tuple[str, ...] = DENY_HOSTS
    max_attempts: int = 4
    delay_seconds: float = 0.25

    def __post_init__(self):
        if self.kind not in ("blog", "product"):
            raise ValueError(f"kind must be 'blog' or 'product', not {self.kind!r}")
        if self.scope not in ("prefix", "host", "none"):
            raise ValueError(f"scope must be 'prefix', 'host' or 'none', not {self.scope!r}")

    @classmethod
    def blog(cls, **changes):
        return cls(**{"kind": "blog", **changes})

    @classmethod
    def product(cls, **changes):
        """Product sites have no scope test and a depth limit."""
        return cls(**{"kind": "product", "scope": "none", "depth_limit": 1000, **changes})
