"""Taking documents in and giving bundles out: crawl frontier, robots rules, HTML to Markdown, links, callouts, changelogs."""

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import count
from pathlib import Path
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators.documents import anchors
from quarryline.session import cut


def crawl(pages: DataFrame, starts: DataFrame, depth: int | None = 4, most: int | None = 100, include: list[str] = (), exclude: list[str] = (), disallowed: list[str] = ()) -> DataFrame:
    """(url, depth): what a walk from the start URLs visits over a table of fetched pages (url, raw), level by level.

    Only web addresses of the start's origin, outside private networks, that match ``include`` (if given) and not ``exclude``
    nor a disallowed path. Within a level the smallest addresses of an origin are visited first, at most ``most`` of each
    origin in all. Without ``depth`` the walk ends where nothing new is found, without ``most`` nothing is left out.
    """
    known = cut(pages.select(T.canonical_url(F.col("url")).alias("url"), "raw").where("url IS NOT NULL").groupBy("url").agg(F.max("raw").alias("raw")))
    origin = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z]+://[^/?#]*)", 1))
    level = starts.select(T.canonical_url(F.col("url")).alias("url")).distinct().withColumns({"origin": origin(F.col("url")), "depth": F.lit(0)})
    visited = None
    for n in count():
        host = T.url_part(F.col("url"), "HOST")
        ok = T.is_http(F.col("url")) & ~F.coalesce(T.is_private_host(host), F.lit(True)) & (origin(F.col("url")) == F.col("origin"))
        path = F.coalesce(T.url_part(F.col("url"), "PATH"), F.lit("/"))
        if include:
            ok = ok & T.matches_any(path, list(include))
        if exclude:
            ok = ok & ~T.matches_any(path, list(exclude))
        for p in disallowed:
            ok = ok & ~path.startswith(p)
        level = level.where(ok)
        if visited is not None:
            level = level.join(visited.select("url"), "url", "left_anti")
        level = level.groupBy("url").agg(F.min("origin").alias("origin"))
        if most is not None:
            level = level.withColumn("at", F.row_number().over(Window.partitionBy("origin").orderBy("url"))).where(F.col("at") <= most)
            if visited is not None:
                level = level.join(visited.groupBy("origin").agg(F.count("*").alias("n")), "origin", "left").where(F.col("at") + F.coalesce("n", F.lit(0)) <= most)
        level = cut(level.select("url", "origin", F.lit(n).alias("depth")))
        visited = level if visited is None else visited.union(level)
        if n == depth or level.isEmpty():
            break
        if n % 20 == 19:
            visited = cut(visited)
        at = known.join(level, "url").select("url", "origin", "raw")
        links = anchors(at, "url", "raw").join(level.select(F.col("url").alias("key"), "origin"), "key")
        href = F.col("href")
        whole = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract("key", "^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat("origin", href))
        whole = whole.when(href.startswith("#") | (href == ""), F.lit(None)).otherwise(F.concat(F.regexp_replace("key", r"[^/]*$", ""), href))
        level = links.select(T.canonical_url(whole).alias("url"), "origin").where("url IS NOT NULL").distinct()
    return visited.select("url", "depth")


def robots_disallowed(text: str | None, paths: list[str], agent: str = "*") -> list[str]:
    """Those of the paths that a robots text forbids; no text forbids none."""
    if not text:
        return []
    p = RobotFileParser()
    p.parse(text.splitlines())
    return [x for x in paths if not p.can_fetch(agent, x)]


_DROP = frozenset("script style noscript svg header footer nav aside".split())
_ROOTS = ("main", "article", "[role=main]", ".markdown-body", ".docs-content", "body")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Markdown(HTMLParser):
    """Markdown per possible content root; the first root of _ROOTS that has text is taken."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.out: dict[str, list[str]] = {r: [] for r in _ROOTS}
        self.title, self.h1, self.dropped, self.links = [], [], 0, []

    def _put(self, s: str) -> None:
        if not self.dropped:
            for _, roots in self.open:
                for r in roots:
                    self.out[r].append(s)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _DROP:
            self.dropped += 1
        if tag not in _VOID:
            names = (a.get("class") or "").split()
            roots = [tag] if tag in _ROOTS else []
            roots += ["[role=main]"] * (a.get("role") == "main") + [f".{c}" for c in names if f".{c}" in _ROOTS]
            self.open.append((tag, tuple(roots)))
        if re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "table", "ul", "ol", "blockquote"):
            self._put("\n\n")
        elif tag == "li":
            self._put("\n- ")
        elif tag == "br":
            self._put("\n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag == "pre":
            self._put("\n\n```\n")
        elif tag == "code":
            self._put("" if any(t == "pre" for t, _ in self.open[:-1]) else "`")
        elif tag in ("strong", "b"):
            self._put("**")
        elif tag in ("em", "i"):
            self._put("*")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self._put("[")
        elif tag in ("td", "th"):
            self._put(" | ")
        elif tag == "tr":
            self._put("\n")

    def handle_endtag(self, tag):
        if tag == "pre":
            self._put("\n```\n\n")
        elif tag == "code":
            self._put("" if any(t == "pre" for t, _ in self.open) else "`")
        elif tag in ("strong", "b"):
            self._put("**")
        elif tag in ("em", "i"):
            self._put("*")
        elif tag == "a" and self.links:
            self._put(f"]({self.links.pop()})")
        if tag in _DROP and self.dropped:
            self.dropped -= 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "title" in tags and "svg" not in tags:
            self.title.append(data)
        if "h1" in tags and not self.dropped:
            self.h1.append(data)
        if "head" not in tags:
            self._put(data if "pre" in tags else re.sub(r"\s+", " ", data))


def to_markdown(page: str) -> tuple[str, str]:
    """(title, Markdown): chrome dropped, from the first content root that has text; the title is the first h1, else <title>."""
    p = _Markdown()
    p.feed(page if re.search(r"<body\b", page, re.I) else f"<body>{page}</body>")
    p.close()
    text = next((t for r in _ROOTS if (t := "".join(p.out[r]).strip())), "")
    title = " ".join("".join(p.h1).split()) or " ".join("".join(p.title).split())
    return title, re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![ \t]*-)", "\n", text)))


def html_to_markdown(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, title, markdown) of HTML pages."""
    rows = pages.select(F.col(key).alias("key"), F.col(raw).alias("raw")).where("raw IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                done = [to_markdown(x) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([m for _, m in done], pa.string())], ["key", "title", "markdown"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, title string, markdown string")


def frontmatter_out(title: Column, kind: Column, tags: Column) -> Column:
    """A frontmatter block whose scalars are quoted as JSON."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("---\ntype: "), quoted(kind), F.lit("\ntitle: "), quoted(title), F.lit("\ntags: ["), F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), quoted), ", "), F.lit("]\n---\n"))


def with_callout(text: Column, summary: Column) -> Column:
    """The text with a summary callout after its first heading, in place of one that is there."""
    bare = F.regexp_replace(text, r"(?m)^> \[!summary\][^\n]*\n(?:>[^\n]*\n)*\n?", "")
    callout = F.concat(F.lit("> [!summary]\n> "), F.regexp_replace(summary, r"\s+", " "), F.lit("\n\n"))
    head = F.regexp_extract(bare, r"(?s)^(.*?(?:^|\n)# [^\n]*\n\n?)", 1)
    return F.when(summary.isNull(), bare).when(head != "", F.concat(head, callout, F.substring(bare, F.length(head) + 1, F.length(bare)))).otherwise(F.concat(callout, bare))


def rewrite_links(docs: DataFrame, key: str, url: str, text: str, paths: DataFrame) -> DataFrame:
    """(key, text) with links to known addresses as bundle paths; ``paths`` is (url, output). Links are joined, then put back in place."""
    found = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), 1)
    base = F.regexp_replace(F.col(url), r"[^/]*$", "")
    origin = F.regexp_extract(F.col(url), r"^([A-Za-z]+://[^/?#]*)", 1)
    each = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), base.alias("base"), origin.alias("origin"), F.explode(F.array_distinct(found)).alias("href"))
    whole = F.when(F.col("href").rlike("^[A-Za-z]+:"), F.col("href")).when(F.col("href").startswith("/"), F.concat("origin", "href")).otherwise(F.concat("base", "href"))
    target = paths.select(T.canonical_url(F.col("url")).alias("to"), "output").groupBy("to").agg(F.min("output").alias("output"))
    hits = each.withColumn("to", T.canonical_url(whole)).join(target, "to").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("href", "output"))).alias("links"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(hits, "key", "left")
    swap = F.aggregate(F.coalesce("links", F.array().cast("array<struct<href:string,output:string>>")), F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("]("), x["href"], F.lit(")")), F.concat(F.lit("](/"), x["output"], F.lit(")"))))
    return rows.select("key", swap.alias("text"))


def changelog_entries(text: DataFrame, column: str) -> DataFrame:
    """(source, pos, at, message) of changelog text: the first line names the source, ``time - message`` lines follow."""
    lines = F.split(T.unix_lines(F.col(column)), "\n")
    rows = text.select(F.element_at(lines, 1).alias("source"), F.posexplode(lines).alias("pos", "line")).where(F.col("line").rlike(r"^\d{4}-\d\d-\d\dT[^ ]+ - "))
    return rows.select("source", "pos", F.try_to_timestamp(F.regexp_extract("line", r"^(\S+) - ", 1)).alias("at"), F.regexp_extract("line", r"^\S+ - (.*)$", 1).alias("message"))


def export_jsonl(df: DataFrame) -> DataFrame:
    """One JSON line a row."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def safe_out_dir(path: str, source: str | None = None) -> Path:
    """The folder to write a bundle to; the root, the home folder, the working folder and the source are refused."""
    p = Path(path).expanduser().resolve()
    if p in (Path("/"), Path.home().resolve(), Path.cwd().resolve()) or (source and p == Path(source).resolve()) or (p / ".git").exists():
        raise ValueError(f"refusing to write to {p}")
    return p


def sarif(findings: list[dict], tool: str) -> str:
    """A SARIF 2.1.0 document of findings (code, severity, message, path, line)."""
    rules = sorted({f["code"] for f in findings})
    results = [{"ruleId": f["code"], "level": "error" if f["severity"] == "error" else "warning", "message": {"text": f.get("message") or f["code"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["path"]}, "region": {"startLine": max(1, f.get("line") or 1)}}}]} for f in findings]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": results}]}, sort_keys=True)
