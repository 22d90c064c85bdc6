"""Job keys, vendor endpoints and application links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import constants as C


def job_key(company_id: Column, ats_job_id: Column) -> Column:
    return F.concat(company_id, F.lit(":"), ats_job_id)


def ats_job_id(job_id: Column) -> Column:
    """What follows the first colon of a job key; later colons belong to the vendor id."""
    return F.regexp_extract(job_id, r"^[^:]*:([\s\S]*)$", 1)


def _per_vendor(vendor: Column, template: dict[str, str], *args: Column) -> Column:
    """The vendor's template filled in; null for a vendor we do not know."""
    expr = F.lit(None).cast("string")
    for name, text in template.items():
        expr = F.when(vendor == name, F.format_string(text, *args)).otherwise(expr)
    return expr


def endpoint(vendor: Column, tenant: Column) -> Column:
    return _per_vendor(vendor, C.ENDPOINT_TEMPLATE, tenant)


def careers_url(vendor: Column, tenant: Column) -> Column:
    return _per_vendor(vendor, C.CAREERS_TEMPLATE, tenant)


def canonical_apply_url(vendor: Column, tenant: Column, job_id: Column) -> Column:
    return _per_vendor(vendor, C.APPLY_TEMPLATE, tenant, job_id)


_URL_SHAPE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"


def url_authority(url: Column) -> Column:
    """Host and port as written, lower case; '' when the URL has none. Never fails on bad URLs."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL_SHAPE, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL_SHAPE, 2)


def resolve_apply(vendor: Column, tenant: Column, job_id: Column, vendor_url: Column) -> Column:
    """Struct ``(url, used_fallback, is_embed)``.

    A vendor link is kept only on a host of that vendor with the job id in its path; any other
    link gives way to the canonical one, and a foreign host is reported as an embed.
    """
    authority = url_authority(vendor_url)
    own_host = F.lit(False)
    for name, hosts in C.APPLY_HOSTS.items():
        own_host = F.when(vendor == name, authority.isin(hosts)).otherwise(own_host)
    trusted = own_host & F.contains(url_path(vendor_url), job_id)
    return F.struct(
        F.when(trusted, vendor_url)
        .otherwise(canonical_apply_url(vendor, tenant, job_id))
        .alias("url"),
        (~trusted).alias("used_fallback"),
        ((authority != "") & ~own_host).alias("is_embed"),
    )
