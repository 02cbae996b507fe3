"""URL and host expressions. Plain patterns: ``parse_url`` raises on bad URLs under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import as_column, clean_text
from postlake.rules.sites import JOB_SITE_HINT, JOB_URL_PATTERN

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def canonical_page_url(url: Column | str) -> Column:
    """Scheme and host lower-cased, fragment dropped, trailing slashes removed, query kept."""
    url = F.trim(as_column(url))
    scheme, host, path, query = (_part(url, i) for i in (1, 2, 3, 4))
    bare = F.regexp_replace(path, "/+$", "")
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""),
        F.when(bare == "", "/").otherwise(bare),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def url_host(url: Column | str) -> Column:
    """Lower-cased host of an absolute URL without user-info and port; NULL when there is none."""
    host = F.lower(
        F.regexp_extract(
            as_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1
        )
    )
    return F.when(host != "", host)


def publisher_site(url: Column | str) -> Column:
    return F.regexp_replace(url_host(url), r"^www[.]", "")


def import_domain(url: Column | str) -> Column:
    """Authority of a feed URL, lower-cased, without a leading 'www.'."""
    return F.regexp_replace(F.lower(_part(as_column(url), 2)), r"^www[.]", "")


def is_http(url: Column | str) -> Column:
    return F.coalesce(F.lower(as_column(url)).rlike("^https?:"), F.lit(False))


def validated_url(url: Column | str) -> Column:
    """The cleaned URL when it is absolute http(s) with a host, else NULL."""
    url = clean_text(url)
    return F.when(url.rlike("^(?i:https?)://[^/?#]+"), url)


def safe_link(url: Column | str) -> Column:
    url = as_column(url)
    return F.when(F.lower(url).rlike("^https?://"), url)


def site_type(domain: Column | str) -> Column:
    """'job_site' when the registered name hints at a vacancy site, else 'other'."""
    name = F.split_part(F.coalesce(as_column(domain), F.lit("")), F.lit("."), F.lit(1))
    return F.when(name.rlike(JOB_SITE_HINT), "job_site").otherwise("other")


def is_job_url(url: Column | str) -> Column:
    return F.lower(as_column(url)).rlike(JOB_URL_PATTERN)
