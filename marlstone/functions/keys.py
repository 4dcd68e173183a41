"""Natural keys of postings, their byte form and 64-bit hashes; canonical JSON hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .primitives import identifier, nullable_text

# Fixed values of the byte form: version, then the domain or what the key locks.
VERSION = "01"
DOMAIN_BYTES = {"tenant": "01", "no_tenant": "02", "url": "03"}
CANONICAL_URL, TENANT_REQUISITION = "04", "05"


def natural_key(provider: Column, source: Column, tenant: Column, job: Column, url: Column) -> Column:
    """struct(domain, provider, source, tenant_id, job_id, url); null if nothing identifies the posting.

    url is a canonical URL.  A job id makes a key in its tenant, or in none; without one the URL is the key.
    """
    tenant, job = nullable_text(tenant), nullable_text(job)
    domain = F.when(job.isNotNull() & tenant.isNotNull(), "tenant").when(job.isNotNull(), "no_tenant").when(url.isNotNull(), "url")
    none = F.lit(None).cast("string")
    return F.when(
        domain.isNotNull(),
        F.struct(domain.alias("domain"), identifier(provider).alias("provider"), identifier(source).alias("source"), F.when(domain == "tenant", tenant).otherwise(none).alias("tenant_id"), job.alias("job_id"), F.when(domain == "url", url).otherwise(none).alias("url")),
    )


def _prefixed(*parts: Column) -> Column:
    """Each part as its length in four bytes, then its UTF-8."""
    return F.concat(*[F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), F.encode(p, "utf-8")) for p in parts])


def key_bytes(key: Column) -> Column:
    p, s = key["provider"], key["source"]
    head = lambda d: F.unhex(F.lit(VERSION + DOMAIN_BYTES[d]))
    return (
        F.when(key["domain"] == "tenant", F.concat(head("tenant"), _prefixed(p, s, key["tenant_id"], key["job_id"])))
        .when(key["domain"] == "no_tenant", F.concat(head("no_tenant"), _prefixed(p, s, key["job_id"])))
        .when(key["domain"] == "url", F.concat(head("url"), _prefixed(p, s, key["url"])))
    )


def hash64(b: Column) -> Column:
    """The first eight bytes of the SHA-256 as a signed number."""
    return F.conv(F.substring(F.sha2(b, 256), 1, 16), 16, -10).cast("long")


def key_hash(key: Column) -> Column:
    return hash64(key_bytes(key))


def url_hash(url: Column) -> Column:
    return hash64(F.concat(F.unhex(F.lit(VERSION + CANONICAL_URL)), _prefixed(url)))


def requisition_hash(provider: Column, source: Column, tenant: Column, requisition: Column) -> Column:
    return hash64(F.concat(F.unhex(F.lit(VERSION + TENANT_REQUISITION)), _prefixed(provider, source, tenant, requisition)))


def derived_id(*parts: Column) -> Column:
    """A UUID made from what it names: a task that runs again gives the same id."""
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def json_hash_of(text: str) -> str:
    """SHA-256 of a JSON object with sorted keys, no spaces, ASCII only; NaN and infinities are errors."""

    def refuse(name: str):
        raise ValueError(f"not JSON: {name}")

    value = json.loads(text, parse_constant=refuse)
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()).hexdigest()


@F.pandas_udf(T.StructType([T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())]))
def canonical_json_hash(s: pd.Series) -> pd.DataFrame:
    """struct(hash, error): a text that is no JSON has an error and no hash; null has neither."""

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return json_hash_of(text), None
        except (ValueError, RecursionError):
            return None, "not JSON"

    return pd.DataFrame([one(x) for x in s.astype(object).where(s.notna(), None)], columns=["hash", "error"])


def manifest_hash(files) -> Column:
    """One hash over the contents of files (a ``binaryFile`` DataFrame), in order of path: an aggregate expression."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("path"), F.sha2("content", 256).alias("h")))), lambda x: F.concat(x["path"], F.lit("\u0001"), x["h"])), "\n"), 256)
