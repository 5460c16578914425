"""Keys of hosts, organisations, addresses and URLs as native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that only track a visit.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a column that is named twice is computed twice within lambdas and filters."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without the white space around it (ASCII's, as patterns have it)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def asset_key(identifier: Column) -> Column:
    return F.lower(trimmed(identifier))


def host_key(c: Column) -> Column:
    """Lower case, without one trailing dot."""
    return F.lower(F.regexp_replace(trimmed(c), r"\.$", ""))


def org_key(c: Column) -> Column:
    """Letters and digits in lower case; other runs become one space."""
    return trimmed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def is_ip4(c: Column) -> Column:
    return c.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")


def ip4_number(c: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    number = lambda parts: sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(is_ip4(c), once(F.split(c, r"\."), number))


def _ip6_groups(c: Column) -> Column:
    """The eight groups of an IPv6 address, of which two colons stand for zeros; null for anything else."""
    def plain(low: Column) -> Column:
        """Without an IPv4 address at its end."""
        v4 = F.regexp_extract(low, r":([0-9.]+)$", 1)
        hexed = lambda n: F.when(n.isNotNull(), F.concat(F.regexp_replace(low, r"[0-9.]+$", ""), F.lower(F.hex(F.floor(n / 65536).cast("bigint"))), F.lit(":"), F.lower(F.hex(n % 65536))))
        return F.when(v4.contains("."), once(ip4_number(v4), hexed)).otherwise(low)

    groups = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
    filled = lambda x: F.when(8 - F.size(x["l"]) - F.size(x["r"]) > 0, F.concat(x["l"], F.array_repeat(F.lit("0"), 8 - F.size(x["l"]) - F.size(x["r"])), x["r"]))
    whole = lambda sides: F.when(F.size(sides) == 1, groups(F.get(sides, F.lit(0)))).when(F.size(sides) == 2, once(F.struct(groups(F.get(sides, F.lit(0))).alias("l"), groups(F.get(sides, F.lit(1))).alias("r")), filled))
    eight = lambda x: once(once(F.split(x, "::", -1), whole), lambda g: F.when(F.size(g) == 8, g))
    form = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$"
    return once(F.lower(trimmed(c)), lambda low: once(plain(low), lambda x: F.when(x.rlike(form), eight(x))))


def ip6_numbers(c: Column) -> Column:
    """An IPv6 address as two signed 64-bit numbers (hi, lo); null for anything else."""
    half = lambda g, at: F.conv(F.array_join(F.transform(F.slice(g, at, 4), lambda x: F.lpad(x, 4, "0")), ""), 16, -10).cast("bigint")
    return once(_ip6_groups(c), lambda groups: F.when(groups.isNotNull(), F.struct(half(groups, 1).alias("hi"), half(groups, 5).alias("lo"))))


def ip_bits(c: Column) -> Column:
    """An address of either kind as a string of its 32 or 128 bits; null for anything else."""
    bits = lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")
    return F.coalesce(F.lpad(F.bin(ip4_number(c)), 32, "0"), F.array_join(F.transform(_ip6_groups(c), bits), ""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def first_non_empty(*values: Column) -> Column:
    """The first value that is not blank, trimmed; else empty."""
    return F.coalesce(*(F.nullif(trimmed(v), F.lit("")) for v in values), F.lit(""))


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, then three dots; a character that the cut would split goes."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(trimmed(cut), F.lit("...")))


def url_host(c: Column) -> Column:
    """The host of a URL or of the text that may be one; that of an IPv6 address without brackets."""
    host = F.regexp_extract(trimmed(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return host_key(F.regexp_replace(host, r"^\[|\]$", ""))


def _unescaped(c: Column) -> Column:
    """Percent escapes decoded; null if one is broken. A plus sign stays."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _query_escaped(c: Column) -> Column:
    """Letters, digits and -_.~ as they are, a space as a plus sign."""
    return _replaced(F.url_encode(c), [("*", "%2A"), ("%7E", "~")])


def _path_escaped(path: Column) -> Column:
    """A path as it is if all its characters may stand in one; else decoded and escaped anew. Null if an escape is broken."""
    fresh = _replaced(_query_escaped(_unescaped(path)), [("+", "%20"), *((f"%{ord(x):02X}", x) for x in "$&+,/:;=@")])
    broken = path.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~broken, F.when(path.rlike(r"^[A-Za-z0-9_.~!$&'()*+,;=:@\[\]/%-]*$"), path).otherwise(fresh))


def normalized_query(query: Column) -> Column:
    """Parameters by lower-case name, the values of one name in their order, escaped anew; none that tracks a visit, none without a name, none that
    cannot be decoded."""
    side = lambda p, i: _unescaped(F.replace(F.coalesce(F.get(F.split(p, "=", 2), F.lit(i)), F.lit("")), F.lit("+"), F.lit(" ")))
    usable = F.filter(F.split(query, "&"), lambda p: ~p.contains(";"))
    pairs = F.transform(usable, lambda p, i: F.struct(F.lower(trimmed(side(p, 0))).alias("name"), i.alias("at"), side(p, 1).alias("value")))
    kept = F.filter(pairs, lambda x: x["value"].isNotNull() & (x["name"] != "") & ~x["name"].startswith("utm_") & ~x["name"].isin(TRACKING))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(_query_escaped(x["name"]), F.lit("="), _query_escaped(x["value"]))), "&")


def normalized_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, a path, the normal form of the query; null unless http(s) and well formed."""
    part = lambda n: F.regexp_extract(trimmed(c), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?", n)
    scheme, host, port, path = F.lower(part(1)), host_key(F.regexp_replace(part(3), r"^\[|\]$", "")), part(4), part(5)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    place = F.when(default, host).when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]:"), port)).otherwise(F.concat(host, F.lit(":"), port))
    query = normalized_query(part(6))
    url = F.concat(scheme, F.lit("://"), part(2), place, F.when(path == "", "/").otherwise(_path_escaped(path)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != "") & ((path == "") | path.startswith("/")), url)


#: Keywords that classify a link, in order of precedence.
LINK_CLASSES = [
    ("privacy", ["privacy"]), ("security", ["security", "trust", "bug bounty"]), ("legal", ["legal", "terms", "cookie"]), ("contact", ["contact", "support", "help"]),
    ("careers", ["career", "jobs", "talent"]), ("about", ["about", "company", "group"]), ("investor_relations", ["investor"]),
]


def link_relation(source: Column, target: Column, anchor: Column) -> Column:
    """The class of a link by its target and text, else by the page it is on."""
    out = None
    for where in (F.lower(F.concat_ws(" ", target, trimmed(anchor))), F.lower(source)):
        for label, words in LINK_CLASSES:
            hit = where.rlike("|".join(words))
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("anchor")


def root_label(root: Column) -> Column:
    """The registrable label of a root; an address is its own."""
    return F.when(ip_bits(root).isNotNull(), root).otherwise(F.substring_index(root, ".", 1))


def root_suffix(root: Column) -> Column:
    """The public suffix of a root; none for an address or a single label."""
    return F.when(ip_bits(root).isNotNull() | ~root.contains("."), "").otherwise(F.regexp_replace(root, r"^[^.]*\.", ""))


def attach_root(df: DataFrame, host: str, rules: DataFrame, out: str = "root") -> DataFrame:
    """``df`` with the registrable root of the column ``host``: one label more than its longest public suffix.

    ``rules`` has suffix (without marks), is_wildcard, is_exception: an exception beats a wildcard beats a plain rule; a host
    without a rule has its last label as suffix; addresses and hosts that are suffixes keep themselves. Suffixes of each
    distinct host are joined with the rules, so the work follows the distinct hosts.
    """
    hosts = df.select(F.col(host).alias("_h")).filter("_h is not null").distinct()
    labels = F.split("_h", r"\.")
    tails = hosts.select("_h", labels.alias("_l"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_p", "_t"))
    # a tail meets plain and exception rules as it is, wildcard rules without its first label: one join holds all three
    forms = F.array(F.struct(F.lit(False).alias("wild"), F.col("_t").alias("text")), F.struct(F.lit(True).alias("wild"), F.regexp_replace("_t", r"^[^.]*\.?", "").alias("text")))
    tails = tails.select("_h", (F.size("_l") - F.col("_p")).alias("_n"), F.inline(forms))
    met = tails.join(rules, (F.col("text") == F.col("suffix")) & (F.col("wild") == (F.col("is_wildcard") & ~F.col("is_exception"))))
    kind = F.when(F.col("is_exception"), 3).when(F.col("wild"), 2).otherwise(1)
    found = met.select("_h", (F.col("_n") - F.col("is_exception").cast("int")).alias("n"), kind.alias("p"))
    best = found.groupBy("_h").agg(F.max(F.struct(F.when(F.col("p") == 3, 1000).otherwise(F.col("n")).alias("w"), "p", "n")).alias("b"))
    roots = hosts.join(best, "_h", "left").withColumn("_n", F.coalesce("b.n", F.lit(1)) + 1)
    whole = is_ip4(F.col("_h")) | (F.size(labels) < F.col("_n"))
    roots = roots.select("_h", F.when(whole, F.col("_h")).otherwise(F.array_join(F.slice(labels, F.size(labels) - F.col("_n") + 1, F.col("_n")), ".")).alias(out))
    return df.join(roots, df[host] == roots["_h"], "left").drop("_h")
