"""Column expressions over text: lines, tokens, words, links, URLs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a topic. (fixed values)
TAG_STOP_WORDS = ("the", "and", "for", "with", "from", "docs")
#: Query parameters that only track. (fixed values)
TRACKING = r"^(utm_.*|fbclid|gclid|mc_.*)$"


def unix_lines(c: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(c, "\r\n?", "\n")


def token_count(c: Column) -> Column:
    """Tokens of a text at four bytes each, rounded up."""
    return F.ceil(F.octet_length(c) / 4).cast("bigint")


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def clean_markdown(c: Column) -> Column:
    """The text without code spans, emphasis, image and link marks."""
    for pattern, to in ((r"`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1")):
        c = F.regexp_replace(c, pattern, to)
    return c


def content_type(path: Column) -> Column:
    """The kind of a document by its file ending; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext == "mdx", "mdx").when(ext.isin("html", "htm"), "html").when(ext.isin("txt", "text"), "text")


def content_type_of_header(header: Column) -> Column:
    """The kind of a document by a content-type header; an empty one means html; null for others."""
    h = F.lower(F.coalesce(header, F.lit("")))
    return F.when((h == "") | h.contains("html"), "html").when(h.contains("markdown"), "markdown").when(h.contains("text/plain"), "text")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob with ``/`` as separator; ``/x/`` is a regular expression already."""
    if len(glob) > 1 and glob.startswith("/") and glob.endswith("/"):
        return glob[1:-1]
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def url_part(c: Column, part: str) -> Column:
    return F.try_parse_url(c, F.lit(part))


def is_http(c: Column) -> Column:
    return F.coalesce(F.lower(url_part(c, "PROTOCOL")).isin("http", "https"), F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    """Whether two URLs have the same scheme and host."""
    return F.lower(url_part(a, "PROTOCOL")).eqNullSafe(F.lower(url_part(b, "PROTOCOL"))) & F.lower(url_part(a, "AUTHORITY")).eqNullSafe(F.lower(url_part(b, "AUTHORITY")))


def canonical_url(c: Column) -> Column:
    """Fragment and tracking parameters dropped, the others sorted, doubled slashes collapsed, the host in lower case; a slash at
    the end is kept only if the URL was given with one."""
    plain = F.split_part(F.trim(c), F.lit("#"), F.lit(1))
    base, query = F.split_part(plain, F.lit("?"), F.lit(1)), F.regexp_extract(plain, r"\?(.*)$", 1)
    origin = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", ""), "/{2,}", "/")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING)))
    return F.concat(origin, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def is_private_host(host: Column) -> Column:
    """Whether a host is the local machine or in a private, shared, link-local or multicast IPv4 range."""
    h = F.lower(host)
    v4 = F.regexp_extract(h, r"^(?:\[?::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\]?$", 1)
    o = F.transform(F.split(v4, r"\."), lambda x: x.try_cast("int"))
    a, b = F.try_element_at(o, F.lit(1)), F.try_element_at(o, F.lit(2))
    ranges = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | (a >= 224)
    return (h == "localhost") | h.endswith(".localhost") | h.isin("::1", "[::1]") | ((v4 != "") & F.coalesce(ranges, F.lit(False)))


def infer_type(title: Column, ident: Column, text: Column) -> Column:
    """What a document is, by its title, id and first 2000 characters."""
    s = F.lower(F.concat_ws(" ", title, ident, F.substring(text, 1, 2000)))
    return (
        F.when(s.rlike(r"(^|[^a-z0-9_])readme([^a-z0-9_]|$)"), "README").when(s.rlike(r"(^|[^a-z0-9_])(api|endpoint|reference)([^a-z0-9_]|$)"), "API Reference")
        .when(s.rlike(r"(^|[^a-z0-9_])(guide|tutorial|quickstart|getting started|how to)([^a-z0-9_]|$)"), "Guide").when(s.rlike(r"(^|[^a-z0-9_])(docs|documentation)([^a-z0-9_]|$)"), "Documentation Page").otherwise("Concept")
    )


def infer_tags(text: Column, most: int = 6) -> Column:
    """The first ``most`` distinct words of 3 to 24 letters or digits that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"https?://[^/\s]*", " ")), F.lit(r"([a-z0-9]+)"), 1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 24) & ~w.isin(*TAG_STOP_WORDS))), 1, most)


def description(text: Column, most: int = 180) -> Column:
    """A one-line description: frontmatter, headings, fences and marks dropped, white space collapsed, ``most`` characters."""
    t = unix_lines(text)
    for pattern, to in ((r"(?s)^---\n.*?\n---\n", ""), (r"(?s)```.*?```", " "), (r"(?m)^#{1,6}[ \t].*$", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[#>*_`~|]", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.substring(F.trim(t), 1, most)
