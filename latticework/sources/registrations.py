"""Registrations of domains from captured RDAP and WHOIS answers, one row a domain. All work is on arrays within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.keys import host_key, trimmed

SCALARS = ["registrar_name", "registrar_iana_id", "registrar_url", "created", "expires", "updated", "registrant_name", "registrant_org", "registrant_email"]
RDAP = """status array<string>, nameservers array<struct<ldhName string>>, events array<struct<eventAction string, eventDate string>>,
 entities array<struct<roles array<string>, vcardArray array<string>, publicIds array<struct<identifier string>>>>"""
#: Date layouts of WHOIS answers.
LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss zzz", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull() & (x.cast("string") != "")), F.lit(0))


def _names(values: Column) -> Column:
    """Sorted distinct values in lower case."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(trimmed(x))), lambda x: x.isNotNull() & (x != ""))))


def from_rdap(bodies: DataFrame) -> DataFrame:
    """From (domain, body). The last readable date of an event counts, the first entity of a role that gives a value. A body
    that is no JSON object gives no row."""
    r = F.from_json("body", RDAP)

    def date(action: str) -> Column:
        at = F.transform(F.filter(r.events, lambda e: e.eventAction == action), lambda e: F.when(e.eventDate.rlike("T.*(Z|[+-][0-9:]{5})$"), F.try_to_timestamp(e.eventDate)))
        return F.try_element_at(F.filter(at, lambda t: t.isNotNull()), F.lit(-1))

    def card(e: Column, name: str) -> Column:
        entries = F.filter(F.from_json(F.get(e.vcardArray, F.lit(1)), "array<array<string>>"), lambda p: (F.size(p) >= 4) & (F.lower(F.get(p, F.lit(0))) == name))
        parts = lambda v: F.array_join(F.filter(F.transform(F.from_json(v, "array<string>"), trimmed), lambda x: x != ""), " ")
        return _first(F.transform(entries, lambda p: trimmed(F.when(F.get(p, F.lit(3)).startswith("["), parts(F.get(p, F.lit(3)))).otherwise(F.get(p, F.lit(3))))))

    has = lambda e, role: F.exists(e.roles, lambda x: F.lower(trimmed(x)) == role)
    owners = F.filter(r.entities, lambda e: has(e, "registrant"))
    registrars = F.filter(r.entities, lambda e: has(e, "registrar") & ~has(e, "registrant"))
    return bodies.filter(F.get_json_object("body", "$").startswith("{")).select(
        host_key(F.col("domain")).alias("domain"), _first(F.transform(registrars, lambda e: F.coalesce(card(e, "org"), card(e, "fn")))).alias("registrar_name"),
        _first(F.transform(registrars, lambda e: trimmed(F.get(e.publicIds, F.lit(0)).identifier))).alias("registrar_iana_id"), F.lit(None).cast("string").alias("registrar_url"),
        date("registration").alias("created"), date("expiration").alias("expires"), date("last changed").alias("updated"),
        _first(F.transform(owners, lambda e: card(e, "fn"))).alias("registrant_name"), _first(F.transform(owners, lambda e: card(e, "org"))).alias("registrant_org"),
        _first(F.transform(owners, lambda e: F.regexp_replace(F.lower(card(e, "email")), "^mailto:", ""))).alias("registrant_email"),
        _names(r.status).alias("statuses"), _names(F.transform(r.nameservers, lambda n: host_key(n.ldhName))).alias("name_servers"),
    )


def from_whois(bodies: DataFrame) -> DataFrame:
    """From (domain, body) of ``key: value`` lines. The first value of a key counts; answers that tell nothing give no row."""
    lines = F.filter(F.transform(F.split("body", "\n"), trimmed), lambda x: (x != "") & ~x.startswith("%") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(trimmed(F.split(x, ":", 2)[0])).alias("k"), trimmed(F.split(x, ":", 2)[1]).alias("v")))
    values = lambda *keys: F.transform(F.filter(F.col("_p"), lambda p: p.k.isin(*keys)), lambda p: p.v)
    date = lambda *keys: _first(F.transform(values(*keys), lambda v: F.coalesce(*(F.try_to_timestamp(v, F.lit(x)) for x in LAYOUTS))))
    rows = bodies.select("domain", pairs.alias("_p")).select(
        host_key(F.col("domain")).alias("domain"), _first(values("registrar name")).alias("registrar_name"), F.lit(None).cast("string").alias("registrar_iana_id"), _first(values("registrar url")).alias("registrar_url"),
        date("creation date").alias("created"), date("expiration date").alias("expires"), date("updated date", "last updated date", "modified date").alias("updated"),
        _first(values("registrant name")).alias("registrant_name"), _first(values("registrant organisation")).alias("registrant_org"), F.lower(_first(values("registrant email"))).alias("registrant_email"),
        _names(values("status", "domain status")).alias("statuses"), _names(F.transform(values("name server"), host_key)).alias("name_servers"),
    )
    return rows.filter(F.coalesce(*SCALARS[:3], *(F.col(c).cast("string") for c in SCALARS[3:6]), *SCALARS[6:]).isNotNull() | (F.size("statuses") > 0) | (F.size("name_servers") > 0))


def coalesced(first: DataFrame, second: DataFrame) -> DataFrame:
    """One registration a domain: ``first``'s values where it has any, lists united."""
    both = first.alias("a").join(second.alias("b"), "domain", "full_outer")
    empty = F.array().cast("array<string>")
    lists = [_names(F.concat(F.coalesce(F.col(f"a.{c}"), empty), F.coalesce(F.col(f"b.{c}"), empty))).alias(c) for c in ("statuses", "name_servers")]
    return both.select("domain", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in SCALARS), *lists)
