"""Fitting texts into token budgets: structural compression, cuts at sections, and the packing of ranked items.

Everything is an expression over the text; a query's items are folded in rank order inside one expression. A token is four
bytes unless a tokenizer is given (``tokens_with``). Null texts stay null; a budget of null or 0 sets no limit.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T

#: Levels of compression: none; structure only; and whole sections within the budget; and a note where it was cut. (fixed values)
LEVELS = ("none", "light", "medium", "aggressive")
#: The note at the end of a text that was cut.
NOTE = "\n\n---\n*[cut to the token budget]*\n"
#: A line of a requirement. (fixed value)
REQUIREMENT = r"\[REQ-\d+\]"
#: Hits of a query that are looked at, tokens of a context, tokens set aside for each item's frame. (fixed values)
HITS, BUDGET, RESERVE = 20, 4000, 50
_FENCE = r"(?m)^[ \t]*```[^\n]*$"


def tokens_with(df: DataFrame, text: str, out: str, encoder: Callable[[], Callable[[str], list]]) -> DataFrame:
    """``df`` with ``out``: the tokens of a text by a tokenizer; ``encoder`` makes it once a task and must be picklable."""
    rest = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            n = [None if t is None else len(encode(t)) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, out])

    return rest.mapInArrow(run, rest.withColumn(out, F.lit(None).cast("bigint")).schema)


def byte_prefix(c: Column, n: Column | int) -> Column:
    """The longest prefix of whole characters within ``n`` bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    cut = F.make_valid_utf8(F.substring(F.encode(c, "utf-8"), F.lit(1), n).cast("string"))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.regexp_replace(cut, "�+$", ""))


def structural(c: Column) -> Column:
    """Runs of blank lines as one and line ends trimmed; outside fences list marks as ``-`` and tabs as two blanks."""
    c = F.regexp_replace(F.regexp_replace(T.unix_lines(c), "\n{3,}", "\n\n"), r"(?m)[ \t]+$", "")
    plain, fences = F.split(c, _FENCE), F.regexp_extract_all(c, F.lit(_FENCE), 0)
    mend = lambda x: F.replace(F.regexp_replace(x, r"(?m)^([ \t]*)[*+] ", "$1- "), F.lit("\t"), F.lit("  "))
    each = F.transform(plain, lambda x, i: F.concat(F.when(i % 2 == 0, mend(x)).otherwise(x), F.coalesce(F.get(fences, i), F.lit(""))))
    return F.array_join(each, "")


def outline(c: Column) -> Column:
    """The headings of a text, each indented by two blanks a level; lines that begin with ``#``, fences not regarded."""
    body = F.regexp_replace(T.unix_lines(c), r"(?s)^---.*?\n---\n?", "")
    heads = F.filter(F.split(body, "\n"), lambda x: F.trim(x).startswith("#"))
    named = F.transform(heads, lambda x: F.struct(F.length(F.regexp_extract(F.trim(x), "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.trim(x), "^#+", "")).alias("title")))
    return F.transform(F.filter(named, lambda h: h["title"] != ""), lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), h["title"]))


def cut_to_sections(c: Column, budget: Column | int, note: bool = False, keep_frontmatter: bool = True) -> Column:
    """Frontmatter and whole leading sections within the budget; a text that fits stays as it is."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    front = F.regexp_extract(c, r"(?s)^(---.*?\n---)", 1)
    body = F.when(front == "", c).otherwise(F.regexp_replace(F.substring(c, F.length(front) + 1, F.length(c)), "^\n", ""))
    front = front if keep_frontmatter else F.lit("")
    room = budget - T.token_count(front)
    sections = F.split(body, r"\n(?=[ \t]*#)")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        cost = T.token_count(F.concat(x, F.lit("\n")))
        full = s["full"] | (s["used"] + cost > room)
        return F.struct(F.when(full, s["used"]).otherwise(s["used"] + cost).alias("used"), F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), full.alias("full"))

    n = F.aggregate(sections, start, step)["n"]
    kept = F.array_join(F.transform(F.slice(sections, F.lit(1), n), lambda x: F.concat(x, F.lit("\n"))), "")
    out = F.concat(front, kept, F.when((n < F.size(sections)) & (F.trim(F.regexp_extract(F.get(sections, n), r"^[ \t]*#+([^\n]*)", 1)) != ""), F.lit(NOTE)).otherwise("") if note else F.lit(""))
    out = F.concat(F.regexp_replace(out, "\n+$", ""), F.lit("\n"))
    return F.when((T.token_count(c) <= budget) | (budget <= 0), c).when((room <= 0) & (front != ""), front).otherwise(out)


def cut_to_heading(c: Column, budget: Column | int) -> Column:
    """The text up to its last heading of level 2 or deeper before it exceeds the budget; else up to that line; else the bytes."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    lines = F.split(c, "\n")
    start = F.struct(F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("n"), F.lit(0).alias("head"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        bytes_ = s["bytes"] + F.octet_length(x) + 1
        full = s["full"] | (F.ceil(bytes_ / 4) > budget)
        head = F.when(F.trim(x).startswith("##"), s["n"]).otherwise(s["head"])
        return F.struct(F.when(full, s["bytes"]).otherwise(bytes_).alias("bytes"), F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), F.when(full, s["head"]).otherwise(head).alias("head"), full.alias("full"))

    f = F.aggregate(lines, start, step)
    leading = lambda n: F.array_join(F.slice(lines, F.lit(1), n), "\n")
    short = F.when(f["head"] > 0, leading(f["head"])).when(f["n"] > 0, F.regexp_replace(leading(f["n"]), "\n+$", "")).otherwise(byte_prefix(c, 4 * budget))
    return F.when((budget <= 0) | (T.token_count(c) <= budget) | ~f["full"], c).otherwise(short)


def compress(c: Column, level: str = "light", budget: Column | int = 0, keep_frontmatter: bool = True) -> Column:
    """A text at one of ``LEVELS``."""
    if level not in LEVELS:
        raise ValueError(f"no such level: {level}")
    if level == "none":
        return c
    c = structural(c)
    return c if level == "light" else cut_to_sections(c, budget, level == "aggressive", keep_frontmatter)


def fit(body: Column, canon: Column, remaining: Column, level: str = "light") -> Column:
    """(how, body, tokens): the whole body if it fits; of an authority item with requirements their lines, word for word, or nothing;
    else the compressed body, or what of it fits. ``how`` is full, requirements, compressed, truncated or deferred."""
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(REQUIREMENT)), F.trim)
    joined, small = F.array_join(lines, "\n"), compress(body, level, remaining)
    bound = canon & (F.size(lines) > 0)
    cut = byte_prefix(small, (4 * remaining).cast("int"))
    fits = lambda x: T.token_count(x) <= remaining
    made = lambda how, x: F.struct(F.lit(how).alias("how"), x.alias("body"), T.token_count(x).alias("tokens"))
    none = F.struct(F.lit("deferred").alias("how"), F.lit(None).cast("string").alias("body"), F.lit(0).cast("bigint").alias("tokens"))
    chosen = F.when(body.isNull() | (remaining <= 0), none).when(fits(body), made("full", body)).when(bound & fits(joined), made("requirements", joined)).when(bound, none)
    return chosen.when(fits(small), made("compressed", small)).when(F.trim(cut) != "", made("truncated", cut)).otherwise(none)


def assemble(ranked: DataFrame, budget: int = BUDGET, hits: int = HITS, level: str = "light") -> DataFrame:
    """(query, key, rank, how, tokens, body): the first ``hits`` items of every query fitted into the budget in rank order; deferred
    ones are listed for a later look. ranked is (query, key, rank, tier, body); the number of hits is a search's own limit."""
    item = F.struct("rank", "key", (F.col("tier") == "canon").alias("canon"), "body")
    rows = ranked.where(F.col("rank") <= hits).groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    made = "array<struct<how:string,body:string,tokens:bigint>>"
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast(made).alias("out"))

    def step(s: Column, x: Column) -> Column:
        one = F.array(fit(x["body"], F.coalesce(x["canon"], F.lit(False)), s["left"], level))
        return F.transform(one, lambda f: F.struct((s["left"] - f["tokens"]).alias("left"), F.concat(s["out"], F.array(f)).alias("out")))[0]

    out = F.aggregate("items", start, step)["out"]
    each = rows.select("query", F.explode(F.arrays_zip("items", out.alias("out"))).alias("z"))
    return each.select("query", "z.items.key", "z.items.rank", "z.out.how", "z.out.tokens", "z.out.body")


def with_neighbours(hits: DataFrame, edges: DataFrame, depth: int = 1, top: int = 3) -> DataFrame:
    """(query, doc, score, rank): the hits, and what lies within ``depth`` edges, either way, of the first ``top`` of them at half their
    score; by score, ties by document. hits is (query, doc, score, rank), edges (src, dst) between documents."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    reached = level = hits.where(F.col("rank") <= top).select("query", "doc", (F.col("score") * 0.5).alias("score"))
    for _ in range(max(1, min(depth, 2))):
        level = level.join(both, level["doc"] == both["src"]).select("query", F.col("dst").alias("doc"), "score").groupBy("query", "doc").agg(F.max("score").alias("score"))
        reached = reached.union(level)
    near = reached.groupBy("query", "doc").agg(F.max("score").alias("score")).join(hits.select("query", "doc"), ["query", "doc"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")).cast("bigint")
    return hits.select("query", "doc", "score").union(near).withColumn("rank", rank)


def assemble_snippets(ranked: DataFrame, about: DataFrame, budget: int = BUDGET, level: str = "light", most: int = 1000) -> DataFrame:
    """(query, doc, rank, packed, tokens, content): snippets in rank order whose cost as JSON fits; ``RESERVE`` tokens are kept free
    while one is cut. ranked is (query, doc, score, rank), about (doc, title, type, description, tags, body). What comes after the
    first ``most`` of a query is deferred too, as everything is once the budget is used."""
    named = ["title", "type", "description", "tags"]
    rows = ranked.join(about.select("doc", *named, "body"), "doc")
    first = rows.where(F.col("rank") <= most).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "score", *named, "body"))).alias("items"))
    made = "array<struct<packed:boolean,tokens:bigint,content:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(made).alias("out"))

    def cost(x: Column, content: Column | None = None) -> Column:
        fields = [x[c].alias(c) for c in ("doc", "score", *named)] + ([content.alias("content")] if content is not None else [])
        return T.token_count(F.to_json(F.struct(*fields)))

    def step(s: Column, x: Column) -> Column:
        room = F.lit(budget) - s["used"] - cost(x) - RESERVE
        text = compress(x["body"], level, room, False) if level != "none" else cut_to_sections(x["body"], room)
        one = F.array(F.coalesce(text, F.lit("")))
        price = lambda t: cost(x, t)
        packed = lambda t: (room > 0) & (s["used"] + price(t) <= budget)
        row = lambda t: F.struct(packed(t).alias("packed"), F.when(packed(t), price(t)).otherwise(F.lit(0).cast("bigint")).alias("tokens"), F.when(packed(t), t).alias("content"))
        return F.transform(F.transform(one, row), lambda r: F.struct((s["used"] + r["tokens"]).alias("used"), F.concat(s["out"], F.array(r)).alias("out")))[0]

    each = first.select("query", F.explode(F.arrays_zip("items", F.aggregate("items", start, step)["out"].alias("out"))).alias("z"))
    out = each.select("query", "z.items.doc", "z.items.rank", "z.out.packed", "z.out.tokens", "z.out.content")
    late = rows.where(F.col("rank") > most).select("query", "doc", "rank", F.lit(False), F.lit(0).cast("bigint"), F.lit(None).cast("string"))
    return out.union(late)


def section_reduction(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, text): headings and the first paragraph of each section, as many of them in order as the budget has room for."""
    body = F.regexp_replace(T.unix_lines(F.col(text)), r"(?s)^---.*?\n---\n?", "")
    sections = F.split(body, r"\n(?=[ \t]*#)")
    head = lambda x: F.regexp_extract(x, r"^([ \t]*#[^\n]*)", 1)
    first = lambda x: F.regexp_extract(F.regexp_replace(x, r"^[ \t]*#[^\n]*\n?", ""), r"(?s)^\s*(.*?)\s*(?:\n[ \t]*\n|\z)", 1)
    short = F.filter(F.transform(sections, lambda x: F.concat_ws("\n", F.nullif(F.trim(head(x)), F.lit("")), F.nullif(first(x), F.lit("")))), lambda x: x != "")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        cost = T.token_count(F.concat(x, F.lit("\n\n")))
        full = s["full"] | (s["used"] + cost > budget)
        return F.struct(F.when(full, s["used"]).otherwise(s["used"] + cost).alias("used"), F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), full.alias("full"))

    kept = F.slice(short, F.lit(1), F.aggregate(short, start, step)["n"])
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.array_join(kept, "\n\n").alias("text"))


def compression_stats(calls: DataFrame) -> DataFrame:
    """(tool, calls, before, after, saved): tokens before and after compression per tool and their share saved in percent; calls is
    (tool, before, after)."""
    sums = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return sums.withColumn("saved", F.when(F.col("before") > 0, F.round(100 * (F.col("before") - F.col("after")) / F.col("before"), 4)).otherwise(0.0))
