"""Host names inside raw values, and links resolved against their page, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.keys import host_key, is_ip4, once, trimmed, url_host

#: Patterns of a host name with several labels, without and with underscores.
HOST = r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
DNS_NAME = r"^([a-z0-9_]([a-z0-9_-]*[a-z0-9_])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$"


def email_host(c: Column) -> Column:
    """The host of an e-mail address with exactly one ``@``; null for anything else."""
    host = lambda parts: F.when((F.size(parts) == 2) & (parts[0] != ""), host_key(F.regexp_replace(parts[1], r"[>?].*$", "")))
    return once(F.split(trimmed(c), "@"), host)


def domain_candidates(c: Column, pattern: str = HOST) -> Column:
    """Distinct host names that a raw value may stand for: host of an address, host of a URL, the value itself."""
    every = lambda raw: F.array_distinct(F.array_compact(F.array(email_host(raw), url_host(raw), host_key(raw))))
    found = lambda raw: F.when(raw.rlike(r"[/?#@:\[\]]"), every(raw)).otherwise(F.array_compact(F.array(host_key(raw))))  # noqa: E731  without these signs all three are one
    return F.filter(once(F.regexp_replace(trimmed(c), r"^\*\.", ""), found), lambda x: x.rlike(pattern) & ~is_ip4(x))


def txt_domains(c: Column) -> Column:
    """Sorted host names in a TXT record: the whole value and the targets of its include, exists, redirect, exp, rua and ruf terms."""
    tokens = F.transform(F.split(trimmed(c), r"[ \t\r\n;]+"), lambda t: F.regexp_replace(t, r"""^["'(),]+|["'(),]+$""", ""))
    term = lambda t: F.regexp_extract(t, r"(?i)^(?:include:|exists:|redirect=|exp=|rua=|ruf=)(.*)$", 1)
    values = F.flatten(F.transform(tokens, lambda t: F.split(term(t), ",")))
    hosts = F.flatten(F.transform(F.concat(F.array(c), F.transform(values, lambda v: F.regexp_replace(trimmed(v), "(?i)^mailto:", ""))), lambda v: domain_candidates(v, DNS_NAME)))
    return F.array_sort(F.array_distinct(hosts))


def resolve_url(base: Column, raw: Column) -> Column:
    """A link as an absolute http(s) URL without fragment and dot segments; null for other schemes and for fragments alone."""
    site, scheme = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0), F.regexp_extract(base, r"^([A-Za-z]+:)//", 1)
    path = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    folder = lambda p: F.when(p == "", "/").otherwise(F.regexp_replace(p, "[^/]*$", ""))
    whole = lambda r: (
        F.when(r == "", None).when(r.rlike("(?i)^https?://[^/]"), r).when(r.startswith("//"), F.concat(scheme, r)).when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(r.startswith("/"), F.concat(site, r)).when(r.startswith("?"), F.concat(site, once(path, lambda p: F.when(p == "", "/").otherwise(p)), r)).otherwise(F.concat(site, once(path, folder), r))
    )
    none = F.array().cast("array<string>")

    def walked(w: Column) -> Column:
        part = lambda n: F.regexp_extract(w, r"^([A-Za-z]+://[^/?#]*)([^?#]*)(.*)$", n)
        steps = F.split(F.regexp_replace(part(2), r"/(\.\.?)$", "/$1/"), "/")
        kept = F.aggregate(steps, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.array_append(a, x)))
        return F.when(w.rlike(r"/\.\.?(/|$|[?#])|[\n\r\x{85}\x{2028}\x{2029}]"), F.concat(part(1), F.array_join(kept, "/"), part(3))).otherwise(F.when(w.isNotNull(), w))

    return once(F.regexp_replace(trimmed(raw), "#.*$", ""), lambda r: once(whole(r), walked))
