"""Web addresses: host, duplicate key, publisher identity, authority."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .text import _col, bind, clean, matched


def host_of(c: Column | str) -> Column:
    """Host without a leading www., lower-cased; empty when the text is not a web address."""
    host = F.lower(F.try_parse_url(_col(c), F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normalise_url(c: Column | str) -> Column:
    """Key under which two spellings of one page meet: no fragment, no tracking parameters, no last slash."""
    url = _col(c)
    page = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_replace(F.substring_index(page, "?", 1), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)$", "$1/")
    params = F.split(F.regexp_extract(page, r"\?(.*)$", 1), "&")
    kept = F.filter(params, lambda p: (p != "") & ~F.lower(p).rlike(fixed.TRACKING_PARAMS))
    kept = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    query = bind(F.array_join(kept, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(q))
    web = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    return F.lower(F.when(web, F.regexp_replace(F.concat(path, query), "/$", "")).otherwise(clean(url)))


def publisher_key(publisher: Column | str, url: Column | str) -> Column:
    """Identity of a source when asking whether two values are independent."""
    return F.concat(F.lower(clean(F.coalesce(_col(publisher), F.lit("")))), F.lit("||"), host_of(url))


def extract_urls(c: Column | str) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(r"""https?://[^\s)"']+"""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;]+$", "")))


def dataset_ref(c: Column | str) -> Column:
    """``owner/name`` of a community dataset page or download address, else null."""
    rule = r"kaggle\.com/(?:api/v1/datasets/download/|datasets/)([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)"
    return F.concat(matched(_col(c), rule, 1), F.lit("/"), matched(_col(c), rule, 2))


def host_authority(c: Column | str) -> Column:
    host = _col(c)
    return (F.when(host.isNull() | (host == ""), F.lit(0.3))
            .when(host.isin(*fixed.AUTHORITATIVE_HOSTS), F.lit(0.8))
            .when(host.rlike(r"(^|\.)gov(\.|$)") | host.endswith(".edu"), F.lit(0.7))
            .when(host.rlike(r"(^|\.)(wikipedia|wikidata)\.org$"), F.lit(0.55))
            .otherwise(F.lit(0.3)))
