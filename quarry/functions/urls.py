"""Column expressions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = "(ref|utm_[a-z]+|fbclid|gclid|session)"


def canonical(url: Column) -> Column:
    """https, lower-case host without www. or m., no fragment, no tracking parameters, no closing slash."""
    out = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(out, "^[A-Za-z]+://([^/?]+)", 1)), "^(www|m)\\.", "")
    rest = F.regexp_replace(F.regexp_extract(out, "^[A-Za-z]+://[^/?]+(.*)$", 1), "([?&])" + TRACKING + "=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "\\?&", "?"), "[?&/]+$", "")
    return F.concat(F.lit("https://"), host, rest)


def kind(url: Column) -> Column:
    """The kind of page that the path tells; first rule first."""
    rules = [("faculty|people|staff", "people"), ("course|program|catalog", "course"), ("news|blog|event", "news"), ("\\.(pdf|docx?|xlsx?)$", "file"), ("^https?://[^/]+/?$", "home")]
    out = F
    for pattern, name in rules:
        out = out.when(F.lower(url).rlike(pattern), name)
    return out.otherwise("page")


def allowed(url: Column) -> Column:
    """Whether a crawler may take it: http(s), no binary ending, no login or calendar path, two parameters at most."""
    bad = "\\.(jpg|png|gif|zip|mp4|css|js)$|/(login|calendar|cart)(/|$)"
    return url.rlike("^https?://") & ~F.lower(F.regexp_replace(url, "[?#].*$", "")).rlike(bad) & (F.size(F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&")) <= 2)
