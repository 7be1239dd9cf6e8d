"""URL expressions (F1-F4, P1-P3): all native Column expressions, so they
stay inside whole-stage codegen and filters on them push below joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme://authority rest ; authority keeps userinfo and port (netloc)
SCHEME_AUTH_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)(.*)$"
ABSOLUTE_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_hash(c) -> Column:
    """md5 hex of the UTF-8 string."""
    return F.md5(_c(c))


def percent_encode(c) -> Column:
    """Percent-encode every run of characters outside printable ASCII
    (UTF-8 bytes, space as %20); printable ASCII is kept as is."""
    runs = F.regexp_extract_all(_c(c), F.lit(r"([!-~]+|[^!-~]+)"), 1)
    enc = F.transform(runs, lambda t: F.when(t.rlike(r"^[!-~]"), t)
                      .otherwise(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))))
    return F.concat_ws("", enc)


def canonical_url(c) -> Column:
    """drop tabs and line breaks, trim blanks and control characters, drop
    query and fragment, lower-case scheme and authority, empty path -> '/',
    percent-encode non-ASCII and blanks."""
    return canonical_from_stripped(strip_query(c))


def strip_query(c) -> Column:
    return F.regexp_replace(trimmed(c), r"(?s)[?#].*$", "")


def trimmed(c) -> Column:
    """A URL as browsers read it: no tabs or line breaks, no blanks or
    control characters around it."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def canonical_from_stripped(u: Column) -> Column:
    scheme = F.lower(F.regexp_extract(u, SCHEME_AUTH_RE, 1))
    auth = F.lower(F.regexp_extract(u, SCHEME_AUTH_RE, 2))
    path = F.regexp_extract(u, SCHEME_AUTH_RE, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    full = F.when(u.rlike(SCHEME_AUTH_RE), F.concat(scheme, F.lit("://"), auth, path)).otherwise(u)
    return percent_encode(full)


def authority(c) -> Column:
    """lower-cased netloc (userinfo and port included); '' if none."""
    return F.lower(F.regexp_extract(_c(c), AUTHORITY_RE, 1))


def url_path(c) -> Column:
    """path component (before query/fragment)."""
    return F.regexp_extract(_c(c), PATH_RE, 1)


def is_from_any_domain(c, domains: Iterable[str]) -> Column:
    """Netloc equals a domain or ends with '.'+domain; empty netloc is
    false. For long lists use ``operators.filters.allowlist_semi`` (J5)."""
    host = authority(c)
    ds = [d.lower() for d in domains]
    if not ds:
        return F.lit(False)
    cond = host.isin(ds)
    for d in ds:
        cond = cond | host.endswith("." + d)
    return F.coalesce((host != "") & cond, F.lit(False))


def has_any_path(c, prefixes: Iterable[str]) -> Column:
    """Lower-cased path starts with a prefix (prefix taken as given)."""
    p = F.lower(url_path(c))
    cond = F.lit(False)
    for pre in prefixes:
        cond = cond | p.startswith(pre)
    return F.coalesce(cond, F.lit(False))


def has_any_extension(c, extensions: Iterable[str]) -> Column:
    """Lower-cased path ends with an extension."""
    p = F.lower(url_path(c))
    cond = F.lit(False)
    for ext in extensions:
        cond = cond | p.endswith(ext)
    return F.coalesce(cond, F.lit(False))


def host_suffixes(host) -> Column:
    """All dot-suffixes of a host: a.b.c -> [a.b.c, b.c, c] (J5 equi key)."""
    parts = F.split(_c(host), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n),
                       lambda i: F.array_join(F.slice(parts, i, n), "."))


def remove_dot_segments(path) -> Column:
    """RFC 3986 dot-segment removal on an absolute path."""
    segs = F.split(_c(path), "/")
    body = F.slice(segs, 2, F.size(segs))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        body, empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def resolve_link(base, href) -> Column:
    """absolute form of an href found on page ``base`` (what a browser's
    ``node.href`` gives): absolute kept, ``//h/p`` takes the base scheme,
    ``/p`` the base authority, ``?q``/``#f``/'' the base path, anything else
    the base directory. Dot segments: ``fix_dot_segments``."""
    b, h = _c(base), trimmed(href)
    b_nofrag = F.regexp_replace(b, r"#.*$", "")
    scheme = F.regexp_extract(b, SCHEME_AUTH_RE, 1)
    auth = F.regexp_extract(b, SCHEME_AUTH_RE, 2)
    b_path = F.regexp_extract(F.regexp_extract(b, SCHEME_AUTH_RE, 3), r"^([^?#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), auth)
    b_dir = F.regexp_extract(b_path, r"^(.*/)", 1)
    b_dir = F.when(b_dir == "", F.lit("/")).otherwise(b_dir)
    joined = (F.when(h.rlike(ABSOLUTE_RE), h)
              .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
              .when(h.startswith("/"), F.concat(origin, h))
              .when(h == "", b_nofrag)
              .when(h.startswith("?"), F.concat(origin, b_path, h))
              .when(h.startswith("#"), F.concat(b_nofrag, h))
              .otherwise(F.concat(origin, b_dir, h)))
    return joined


def fix_dot_segments(joined) -> Column:
    """Remove dot segments from the path of a hierarchical URL."""
    joined = _c(joined)
    j_scheme = F.regexp_extract(joined, SCHEME_AUTH_RE, 1)
    j_auth = F.regexp_extract(joined, SCHEME_AUTH_RE, 2)
    j_rest = F.regexp_extract(joined, SCHEME_AUTH_RE, 3)
    j_path = F.regexp_extract(j_rest, r"^([^?#]*)", 1)
    j_tail = F.regexp_extract(j_rest, r"(?s)^[^?#]*(.*)$", 1)
    fixed = F.concat(j_scheme, F.lit("://"), j_auth,
                     F.when(j_path.startswith("/"), remove_dot_segments(j_path)).otherwise(j_path),
                     j_tail)
    return F.when(joined.rlike(SCHEME_AUTH_RE), fixed).otherwise(joined)


def document_base(url, base_href) -> Column:
    """what a page's links are resolved against: the href of its base
    element, itself resolved against the page's URL, or that URL where there
    is none or where it gives no hierarchical URL (``data:``, ``mailto:``)."""
    resolved = fix_dot_segments(resolve_link(url, base_href))
    return F.when(resolved.rlike(SCHEME_AUTH_RE), resolved).otherwise(_c(url))
