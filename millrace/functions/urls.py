"""URL functions: Column -> Column. Unparseable input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IP = "^" + "[.]".join(["[0-9][0-9]?[0-9]?"] * 4) + "$"


def hostname(url: Column) -> Column:
    """Lower case, without user information and port."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def netloc(url: Column) -> Column:
    """As written: user information, port and case stay."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def base_url(url: Column) -> Column:
    """Without scheme, query and fragment."""
    return F.substring_index(F.substring_index(F.regexp_replace(url, "^[^:/?#]+://", ""), "#", 1), "?", 1)


# Labels that stand below a country's two letters in its public suffixes of two labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "or", "org", "plc", "sch")
TWO_LABELS = f"(?:{'|'.join(SECOND_LEVEL)})[.][a-z][a-z]"


def public_suffix(host: Column, suffixes: list[str] | None = None) -> Column:
    """The last label, or the last two where they are a country's second level (co.uk) or in `suffixes`, a
    caller's list of suffixes of two labels; null for an IP."""
    two = F.substring_index(host, ".", -2)
    known = two.rlike(f"^{TWO_LABELS}$") | (two.isin(suffixes) if suffixes else F.lit(False))
    return F.when(host.rlike(IP), None).when(known, two).otherwise(F.substring_index(host, ".", -1))


def registrable_domain(host: Column, suffixes: list[str] | None = None) -> Column:
    """The public suffix and one label more; an IP as it is; null for a bare label or a bare suffix."""
    suffix = public_suffix(host, suffixes)
    more = F.substring_index(F.left(host, F.length(host) - F.length(suffix) - 1), ".", -1)
    return F.when(host.rlike(IP), host).when(host.contains(".") & (host != suffix), F.concat_ws(".", more, suffix))


def with_scheme(url: Column) -> Column:
    """http:// before a URL that doesn't begin with http."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))


def third_party(request_domain: Column, site_domain: Column) -> Column:
    """Null if either is unknown."""
    return F.when(request_domain.isNull() | site_domain.isNull(), None).otherwise(request_domain != site_domain)


def glued_path(url: Column) -> Column:
    """Path, parameters, query and fragment put together without their separators."""
    rest = F.regexp_replace(url, "^[^:/?#]+://[^/?#]*", "")
    before = F.substring_index(rest, "#", 1)
    after = F.when(F.contains(rest, F.lit("#")), F.regexp_replace(rest, "^[^#]*#", "")).otherwise("")
    path = F.regexp_replace(F.substring_index(before, "?", 1), ";([^/]*)$", "$1")
    query = F.when(F.contains(before, F.lit("?")), F.regexp_replace(before, "^[^?]*[?]", "")).otherwise("")
    return F.concat(path, query, after)


def strip_www_letters(host: Column) -> Column:
    """Without leading letters w and dots: a set of characters, not a prefix."""
    return F.ltrim(host, F.lit("w."))


def resolved(href: Column, page: Column) -> Column:
    """An absolute same-site URL of an href, or null: absolute, protocol-relative and root-relative forms."""
    scheme, host = F.substring_index(page, "://", 1), netloc(page)
    clean = F.translate(F.trim(href), "\r\n\t", "")
    full = F.when(clean.rlike("^https?://"), clean).when(clean.startswith("//"), F.concat(scheme, F.lit(":"), clean)).when(clean.startswith("/"), F.concat(scheme, F.lit("://"), host, clean))
    return F.when(registrable_domain(hostname(full)) == registrable_domain(hostname(page)), full)
