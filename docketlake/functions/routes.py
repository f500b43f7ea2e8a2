"""Routes of downloads: bounded decoding, path normalisation, family and number; planned paths that collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.records import nfkc
from docketlake.functions.text import let

#: The route of a download, a path that looks like one, and how often a path is decoded.
ROUTE = r"(?i)^/liz/([A-Za-z0-9]+)/Downloads/(PublicTestimonyDocument|CommitteeMeetingDocument)/([0-9]+)/?$"
CANDIDATE = r"(?i)/liz/[A-Za-z0-9]+/Downloads/(?:PublicTestimonyDocument|CommitteeMeetingDocument)/"
ROUNDS = 3


def decoded(path: Column, rounds: int = ROUNDS) -> Column:
    """The path after percent-decoding, as often as it changes but at most `rounds` times. A plus sign is itself; a sequence that cannot be decoded leaves the path as it is."""
    for _ in range(rounds):
        path = let(path, lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
    return path


def normal_path(path: Column) -> Column:
    """The path with backslashes as slashes, and without empty, `.` and `..` parts; `..` does not lead above the root; an empty path is `.`."""
    return let(F.replace(path, F.lit("\\"), F.lit("/")), _without_dots)


def _without_dots(text: Column) -> Column:
    rooted = text.startswith("/")
    parts = F.filter(F.split(text, "/"), lambda x: (x != "") & (x != "."))
    last = lambda acc: F.element_at(F.concat(F.array(F.lit("..")), acc), -1)
    less = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(last(acc) != "..", less(acc)).when(rooted, acc).otherwise(F.concat(acc, F.array(x))))
    lead = F.when(text.startswith("//") & ~text.startswith("///"), "//").when(rooted, "/").otherwise("")
    return F.coalesce(F.nullif(F.concat(lead, F.array_join(kept, "/")), F.lit("")), F.when(text.isNotNull(), "."))


def url_path(url: Column) -> Column:
    """The path of a URL, without scheme, authority, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")


def download_route(url: Column, host: str) -> Column:
    """struct(session, family, id, problem) of a download URL.

    The path is decoded and normalised before it is matched. Problems: null_byte; not_canonical, if the path contains a route but is none; untrusted, if the route is not on the
    host over https at its port without user-info; no_route. A relative URL is on the host. The other fields are null where there is a problem.
    """
    return let(decoded(url_path(url)), lambda path: let(normal_path(path), lambda normal: _route(url, host, path, normal)))


def _route(url: Column, host: str, path: Column, normal: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(normal, ROUTE, k), F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":([^:@\]]*)$", 1)
    named = F.rtrim(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[^:\]]*$", ""), F.lit("."))
    trusted = (authority == "") & (scheme == "") | (scheme.isin("https", "")) & (named == host) & port.isin("", "443") & ~authority.contains("@")
    problem = F.when(F.contains(path, F.lit("\x00")), "null_byte").when(part(3).isNull(), F.when(normal.rlike(CANDIDATE), "not_canonical").otherwise("no_route")).when(~trusted, "untrusted")
    fine = lambda c, found: F.when(found.isNull(), c)
    return let(F.when(url.isNull(), "no_route").otherwise(problem), lambda p: F.struct(fine(F.upper(part(1)), p).alias("session"), fine(F.lower(part(2)), p).alias("family"), fine(part(3), p).alias("id"), p.alias("problem")))


def path_collisions(planned: DataFrame, path: str = "path", key: str = "doc_key") -> DataFrame:
    """(folded, level, n, paths): planned paths that a file system could not hold side by side.

    Level `same`: equal paths of several documents. Level `folded`: paths that differ, but are equal in compatibility form and without case. Documents are counted by key, so
    a plan that lists one twice does not collide with itself. Equal paths are counted before they are folded.
    """
    exact = planned.groupBy(path).agg(F.countDistinct(key).alias("n"))
    folded = F.lower(F.upper(nfkc(F.col(path))))
    each = exact.withColumn("folded", folded)
    groups = each.groupBy("folded").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"), F.max("n").alias("most"), F.sort_array(F.collect_set(path)).alias("paths"))
    return groups.where("spellings > 1 or most > 1").select("folded", F.when(F.col("spellings") > 1, "folded").otherwise("same").alias("level"), "n", "paths")
