"""URL and page functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of URLs that are no photographs; marks of blocking pages.
SKIPPED = ("gstatic.com/images/branding", "google.com/images", "favicon", "logo")
BLOCKED = ("enablejs", "/sorry/", "unusual traffic", "before you continue", "update your browser")
#: What a browser's page and address show when it is blocked.
BLOCKED_URLS = ("/sorry/", "google.com/sorry")
BLOCKED_TEXTS = ("our systems have detected unusual traffic", "unusual traffic from your computer network", "verify you're not a robot", "to continue, please verify that you are not a robot")
#: Fixed values: (pattern, group) of image addresses in a page of results, in the order in which they are tried.
IMAGE_PATTERNS = [
    (r"(?i)http[^\[\]\"\\]+?\.(?:jpg|jpeg|png|bmp|webp)(?:\?[^\[\]\"\\]*)?", 0),
    (r'"ou":"(https?://[^"]+)"', 1),
    (r'"ow":\d+,"oh":\d+,"ou":"(https?://[^"]+)"', 1),
    (r'imgurl=(https?[^&"]+)', 1),
    (r'\\"(https?:\\\\/\\\\/[^\\"]+\.(?:jpg|jpeg|png|webp)[^\\"]*)\\"', 1),
]
#: Suffixes of images, and content types in the order in which they are tried.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "gif")
TYPES = ("jpg", "png", "webp", "gif", "bmp")
#: Hosts of thumbnails, which sort last.
CACHE_HOST, THUMBNAIL = "gstatic.com", "encrypted-tbn0.gstatic.com"


def domain(url: Column) -> Column:
    """The network location (with port and user), lower-cased."""
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def unescaped(url: Column) -> Column:
    """Backslash escapes undone (as those of a JSON string), then
    percent-decoding that leaves a plus as it is. A text that cannot be decoded
    stays as it is."""
    text = F.concat(F.lit('["'), F.regexp_replace(url, r'(?<!\\)"', r'\\"'), F.lit('"]'))
    plain = F.coalesce(F.get(F.from_json(text, "array<string>", {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}), F.lit(0)), url)
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def found_urls(page: Column, patterns: list[tuple[str, int]] = IMAGE_PATTERNS) -> Column:
    """What the patterns find, decoded: script after script, then the whole
    page, pattern after pattern; each address once, where it is first found,
    and only those of http."""
    scripts = F.regexp_extract_all(page, F.lit(r"(?is)<script\b.*?</script>"), F.lit(0))
    within = lambda part: F.flatten(F.array(*[F.regexp_extract_all(part, F.lit(p), F.lit(k)) for p, k in patterns]))
    found = F.concat(F.flatten(F.transform(scripts, within)), within(page))
    return F.array_distinct(F.filter(F.transform(found, unescaped), lambda u: F.startswith(u, F.lit("http"))))


def is_blocked(page: Column) -> Column:
    low = F.lower(page)
    out = F.lit(False)
    for m in BLOCKED:
        out = out | F.contains(low, F.lit(m))
    return out


def is_blocked_browser(page: Column, url: Column) -> Column:
    """The same for the page and address that a browser shows."""
    out = F.lit(False)
    for text, marks in ((url, BLOCKED_URLS), (page, BLOCKED_TEXTS)):
        for m in marks:
            out = out | F.contains(F.lower(text), F.lit(m))
    return out


def is_result_page(images: Column, originals: Column) -> Column:
    return (images >= 3) | (originals >= 3)


def is_skipped(url: Column) -> Column:
    """Not http, a name of decoration, or a path that ends in .svg exactly."""
    low = F.lower(url)
    out = ~F.startswith(low, F.lit("http"))
    for s in SKIPPED:
        out = out | F.contains(low, F.lit(s))
    return out | F.coalesce(F.endswith(F.try_parse_url(url, F.lit("PATH")), F.lit(".svg")), F.lit(False))


def suffix_guess(url: Column, content_type: Column) -> Column:
    """File suffix by the path, then by the content type, else .jpg."""
    own = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), rf"(?i)[^/](\.(?:{'|'.join(SUFFIXES)}))$", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(own != "", own).when(F.contains(kind, F.lit("jpeg")), ".jpg")
    for name in TYPES:
        out = out.when(F.contains(kind, F.lit(name)), "." + name)
    return out.otherwise(".jpg")


def url_priority(url: Column) -> Column:
    """0 for a page's own image, 1 for a cached one, 2 for a thumbnail."""
    low = F.lower(url)
    return F.when(F.contains(low, F.lit(THUMBNAIL)), 2).when(F.contains(low, F.lit(CACHE_HOST)), 1).otherwise(0)


def normalised_query(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def search_url(base: str, query: Column, offset: Column) -> Column:
    return F.concat(F.lit(base + "?q="), F.url_encode(query), F.lit("&start="), offset.cast("string"))


def accepted_download(content_type: Column, size: Column, least: int = 1024) -> Column:
    """A content type, where there is one, must name an image; a body has at least so many bytes."""
    return (content_type.isNull() | F.contains(F.lower(content_type), F.lit("image"))) & (size >= least)
