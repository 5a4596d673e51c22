"""Functions on urls. The four keys differ on purpose: results depend on which one a join uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Hosts of forums and of video platforms.
FORUM_HOSTS = ("reddit.com", "quora.com", "stackexchange.com", "stackoverflow.com", "gutefrage.net")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com")
# Words in url and title that tell what a page is for.
TRANSACTIONAL = ("/product", "/buy", "/pricing", "/shop", "kaufen", "preis")
COMMERCIAL = ("best", "review", " vs ", "vergleich", "test", "beste")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++$", "")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(strip(url), _URL, n)


def _path(url: Column) -> Column:
    path = F.regexp_replace(_part(url, 3), "(?<!/)/++$", "")
    return F.when(path == "", "/").otherwise(path)


def collector_key(url: Column) -> Column:
    """Scheme and host in lower case, path without final slashes; parameters and fragment are dropped."""
    key = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _path(url))
    return F.when(F.coalesce(strip(url), F.lit("")) == "", "").otherwise(key)


def repair_key(url: Column) -> Column:
    """No scheme, no leading www., parameters kept, fragment dropped; "" for null or blank."""
    host = F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")
    query = _part(url, 4)
    key = F.concat(host, _path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(strip(url), F.lit("")) == "", "").otherwise(key)


def validation_key(url: Column) -> Column:
    """The same intent by another way: the scheme is cut, then the fragment, then host and rest are split."""
    bare = F.regexp_replace(F.regexp_replace(strip(url), r"(?i)^https?://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^www\.", "")
    rest = F.when(F.contains(bare, F.lit("/")), F.regexp_replace(bare, r"^[^/]*", "")).otherwise("/")
    base = F.regexp_replace(F.substring_index(rest, "?", 1), "(?<!/)/++$", "")
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*", "")).otherwise("")
    key = F.concat(host, F.when(base == "", "/").otherwise(base), query)
    return F.when(F.coalesce(strip(url), F.lit("")) == "", "").otherwise(key)


def passage_key(url: Column) -> Column:
    """All in lower case, without scheme, leading www. and final slashes; parameters and fragment stay."""
    bare = F.regexp_replace(F.lower(strip(url)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), "(?<!/)/++$", "")


def domain_strict(url: Column) -> Column:
    """The host, NULL if no slash follows it."""
    return F.nullif(F.regexp_extract(url, r"https?://([^/]+)/", 1), F.lit(""))


def domain_loose(url: Column) -> Column:
    """The host, with or without a slash after it."""
    return F.nullif(F.regexp_extract(url, r"https?://([^/]+)/?", 1), F.lit(""))


def without_www(domain: Column) -> Column:
    """"www." removed wherever it stands, not only in front."""
    return F.replace(domain, F.lit("www."), F.lit(""))


def clean_domain(domain: Column) -> Column:
    """The label of a markdown link around the domain, in lower case, without leading www.; "" for null."""
    text = strip(domain)
    label = F.when(F.rlike(text, F.lit(r"^\[[^\]]*\]\([^)]*\)")), F.regexp_extract(text, r"^\[([^\]]*)\]", 1)).otherwise(text)
    return F.coalesce(F.regexp_replace(F.lower(strip(label)), r"^www\.", ""), F.lit(""))


def clean_url(url: Column) -> Column:
    """The target of a markdown link around the url; "" for null."""
    text = strip(url)
    target = F.regexp_extract(text, r"^\[[^\]]*\]\(([^)]*)\)", 1)
    return F.coalesce(strip(F.when(F.rlike(text, F.lit(r"^\[[^\]]*\]\([^)]*\)")), target).otherwise(text)), F.lit(""))


# Forms of a video's id in a url, and of a start time.
ID_WATCH, ID_SHORT = r"[?&]v=([A-Za-z0-9_-]+)", r"youtu\.be/([A-Za-z0-9_-]+)"
ID_COUNTED = (
    r"[?&]v=([A-Za-z0-9_-]{6,})",
    r"/(?:shorts|embed|v)/([A-Za-z0-9_-]{6,})",
    r"youtu\.be/([A-Za-z0-9_-]{6,})",
)
ID_PATH, OFFSET = r"^/(?:embed|shorts|v)/([A-Za-z0-9_-]{6,})", r"[?&]t=(\d+)"


def _first(url: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


def video_id_parsed(url: Column) -> Column:
    """From the url's parts: watch?v=, /embed, /shorts, /v on youtube.com; the first path segment on youtu.be."""
    host = F.replace(F.lower(_part(url, 2)), F.lit("www."), F.lit(""))
    query = F.concat(F.lit("&"), _part(url, 4))
    watch = F.when(_part(url, 3) == "/watch", F.nullif(F.regexp_extract(query, r"[&;]v=([^&;]+)", 1), F.lit("")))
    path = F.nullif(F.regexp_extract(_part(url, 3), ID_PATH, 1), F.lit(""))
    short = F.nullif(F.regexp_extract(_part(url, 3), r"^/*([^/]*)", 1), F.lit(""))
    on_site = F.when(_part(url, 3) == "/watch", watch).otherwise(path)
    return F.when(F.contains(host, F.lit("youtube.com")), on_site).when(F.contains(host, F.lit("youtu.be")), short)


def video_id_pattern(url: Column) -> Column:
    return _first(url, ID_WATCH, ID_SHORT)


def video_id_watch(url: Column) -> Column:
    return _first(url, ID_WATCH)


def video_id_counted(url: Column) -> Column:
    """Ids of six or more characters, only where the url names the platform."""
    return F.when(F.contains(F.lower(url), F.lit("youtu")), _first(url, *ID_COUNTED))


def offset_seconds(url: Column) -> Column:
    return F.regexp_extract(url, OFFSET, 1).try_cast("bigint")


def _any_contains(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def is_forum(url: Column) -> Column:
    return _any_contains(F.lower(_part(url, 2)), FORUM_HOSTS).cast("int")


def is_video_host(url: Column) -> Column:
    return _any_contains(F.lower(_part(url, 2)), VIDEO_HOSTS).cast("int")


def is_https(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit("https")), F.lit(False)).cast("int")


def content_type(url: Column, title: Column, has_product: Column | None = None) -> Column:
    text = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    sells = _any_contains(text, TRANSACTIONAL)
    if has_product is not None:
        sells = sells | F.coalesce(has_product, F.lit(False))
    return F.when(sells, "transactional").when(_any_contains(text, COMMERCIAL), "commercial").otherwise("informational")
