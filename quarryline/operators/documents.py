"""Documents: structure, titles, tags, budgets, requirement lines, bundles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import markdown as M
from quarryline.functions import text as T

#: Words by which a requirement obliges; ambiguous verbs. (fixed values)
NORMATIVE = r"(?i)(?:^|[^0-9A-Za-z_])(shall|must|should)(?=[^0-9A-Za-z_]|$)"
AMBIGUOUS = r"(?i)(?:^|[^0-9A-Za-z_])(support|handle|allow|enable)(?=[^0-9A-Za-z_]|$)"


def newest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """One row per key: that with the newest time."""
    best = F.max_by(F.struct(*columns), F.struct(at, *[F.to_json(F.struct(c)) for c in columns])).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "r.*")


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, label, href) of every inline link, titles dropped."""
    found = F.regexp_extract_all(text, F.lit(r"\[([^\]\[]*)\]\(\s*[^)\s]+(?:\s+\"[^\"]*\")?\s*\)"), 0)
    each = df.where(F.col(text).contains("](")).select(F.col(key).alias("key"), F.posexplode(found).alias("pos", "link"))
    return each.select("key", (F.col("pos") + 1).alias("pos"), F.regexp_extract("link", r"^\[([^\]\[]*)\]", 1).alias("label"), F.regexp_extract("link", r"\]\(\s*([^)\s]+)", 1).alias("href"))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href) of every anchor of a page, in the page's order of first appearance, distinct."""
    return pages.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), 1))).alias("href"))


def requirements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, id, text, problem) of every ``[ID] text`` line outside fences; problem is null, 'bad-id' or 'empty-text'."""
    line = F.trim(F.regexp_replace(F.trim("line"), r"^([-*+]|\d+\.)\s+", ""))
    rows = M.lines(df, key, text).where("NOT fenced AND depth = 0").select("key", "line_no", line.alias("line")).where(F.col("line").rlike(r"^\[[^\]]*\]") & ~F.col("line").rlike(r"^\[[^\]]*\]\("))
    ident, body = F.trim(F.regexp_extract("line", r"^\[([^\]]*)\]", 1)), F.trim(F.regexp_extract("line", r"(?s)^\[[^\]]*\](.*)$", 1))
    return rows.select("key", "line_no", ident.alias("id"), body.alias("text"), F.when(~ident.rlike("^REQ-[0-9]+$"), "bad-id").when(body == "", "empty-text").alias("problem"))


def requirement_issues(reqs: DataFrame) -> DataFrame:
    """(key, line_no, code) for well-formed requirements: casing, several or no obliging words, If without then, ambiguous verbs, repeats."""
    ok = reqs.where("problem IS NULL").withColumns({"words": F.regexp_extract_all("text", F.lit(NORMATIVE), 1), "vague": F.regexp_extract_all("text", F.lit(AMBIGUOUS), 1)})
    then = F.col("text").rlike(r"(?i)(^|[^0-9A-Za-z_])then([^0-9A-Za-z_]|$)")
    codes = F.array_compact(F.array(
        F.when(F.exists("words", lambda w: w != F.upper(w)), "non-normative-keyword"), F.when(F.size("words") > 1, "not-singular"), F.when(F.size("words") == 0, "no-keyword"),
        F.when((F.size("words") > 0) & F.col("text").rlike(r"(?i)^\s*if([^0-9A-Za-z_]|$)") & ~then, "if-without-then"), F.when(F.size("vague") > 0, "ambiguous-verb"),
    ))
    one = ok.select("key", "line_no", F.explode(codes).alias("code"))
    order = Window.partitionBy("key", "id").orderBy("line_no")
    repeated = ok.withColumn("n", F.row_number().over(order)).where("n > 1").select("key", "line_no", F.lit("duplicate-id").alias("code"))
    return one.union(repeated)


def scale(df: DataFrame, text: str, concepts: tuple[int, int] = (100, 150), tokens: tuple[int, int] = (400_000, 600_000)) -> DataFrame:
    """One row: documents, tokens, average, and whether a limit is near or passed."""
    n, t = F.count("*"), F.coalesce(F.sum(T.token_count(F.col(text))), F.lit(0))
    level = F.when((F.col("documents") > concepts[1]) | (F.col("tokens") > tokens[1]), "exceeded").when((F.col("documents") > concepts[0]) | (F.col("tokens") > tokens[0]), "warning").otherwise("ok")
    return df.agg(n.alias("documents"), t.alias("tokens")).withColumns({"average": F.round(F.col("tokens") / F.col("documents"), 4), "level": level})


def frontmatter(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, type, title, tags, valid) of JSON frontmatter; a broken one gives nulls."""
    parsed = F.from_json(column, "type string, title string, tags array<string>", {"mode": "PERMISSIVE"})
    good = F.try_parse_json(F.col(column)).isNotNull()
    return df.select(F.col(key).alias("key"), F.when(good, parsed).alias("f"), F.coalesce(good, F.lit(False)).alias("valid")).select("key", "f.type", "f.title", "f.tags", "valid")


def output_paths(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, output): a Markdown path for every document; reserved names are changed, the n-th of a name gets ``-n``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.col(path)), r"\.[a-z0-9]+$", ""), r"[^a-z0-9/._~\-]+", "-")
    leaf = F.regexp_extract(bare, r"([^/]*)$", 1)
    safe = F.regexp_replace(bare, r"[^/]*$", "")
    named = F.concat(safe, F.when(leaf == "index", "home").when(leaf == "readme", "overview").when(leaf.isin("log", "changelog"), "change-log").otherwise(leaf))
    n = F.row_number().over(Window.partitionBy("base").orderBy("key"))
    return df.select(F.col(key).alias("key"), named.alias("base")).distinct().select("key", F.concat("base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md")).alias("output"))


def index_pages(df: DataFrame, path: str, title: str) -> DataFrame:
    """(folder, entries, listing): per folder its documents by title; the listing lines are ordered and joined."""
    rows = df.select(F.regexp_replace(path, "/?[^/]*$", "").alias("folder"), F.struct(F.coalesce(title, F.col(path)).alias("title"), F.col(path).alias("path")).alias("e")).distinct()
    listing = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.concat(F.lit("- ["), e["title"], F.lit("]("), e["path"], F.lit(")"))), "\n")
    return rows.groupBy("folder").agg(F.count("*").alias("entries"), listing.alias("listing"))


def comparable(c: Column) -> Column:
    """A body as it is compared between bundles: without frontmatter, summary callout and carriage returns."""
    c = F.regexp_replace(T.unix_lines(c), r"(?s)^---\n.*?\n---\n", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^> \[!summary\][^\n]*\n(?:>[^\n]*\n)*", ""), r"^\s+|\s+$", "")


def bundle_diff(old: DataFrame, new: DataFrame, path: str, body: str) -> DataFrame:
    """(path, change): added, deleted or modified between two bundles, by a full outer join; reserved files do not count."""
    side = lambda df, name: df.where(~F.col(path).rlike(r"(^|/)(index|log)\.md$")).select(F.col(path).alias("path"), F.coalesce(comparable(F.col(body)), F.lit("")).alias(name)).distinct()
    both = side(old, "old").join(side(new, "new"), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def word_summary(text: Column, most: int = 200) -> Column:
    """The first prose paragraph without marks, cut at a word within ``most`` characters."""
    paragraphs = F.filter(F.split(T.unix_lines(text), "\n[ \t]*\n"), lambda p: ~F.trim(p).rlike(r"^(#|```|~~~|[-*+] |\||>|!\[|\d+\. )") & (F.trim(p) != ""))
    plain = F.trim(F.regexp_replace(T.clean_markdown(F.try_element_at(paragraphs, F.lit(1))), r"\s+", " "))
    cut = F.regexp_replace(F.substring(plain, 1, most), r"\s+\S*$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("...")))
