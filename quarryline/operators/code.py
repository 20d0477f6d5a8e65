"""Code as relations: symbols, who refers to whom, the dependency graph, dead code, clones, health findings and scores."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import graph as G
from quarryline.operators.ranks import ranked
from quarryline.operators.references import resolve_address


def definitions(symbols: DataFrame) -> DataFrame:
    """The definitions, with ``id`` = language:path#name@line."""
    ident = F.concat("language", F.lit(":"), "file", F.lit("#"), "name", F.lit("@"), F.col("line").cast("string"))
    return symbols.where("kind = 'def'").withColumn("id", ident).drop("kind")


def references(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'ref'").select("repo", "file", "name", "line")


def outline(symbols: DataFrame) -> DataFrame:
    """(repo, file, id, type, name, parent, line, pos): the definitions of a file in order."""
    order = Window.partitionBy("repo", "file").orderBy("line", "name")
    return definitions(symbols).select("repo", "file", "id", "type", "name", "parent", "line", F.row_number().over(order).cast("bigint").alias("pos"))


def find(symbols: DataFrame, name: str, kind: str | None = None, exact: bool = False) -> DataFrame:
    """Definitions by name, case aside; struct, union and record count as class."""
    want = F.lower(F.col("name")) == name.lower() if exact else F.lower(F.col("name")).contains(name.lower())
    rows = definitions(symbols).where(want)
    return rows.where(F.col("type") == {"struct": "class", "union": "class", "record": "class"}.get(kind, kind)) if kind else rows


def parse_symbol_id(c: Column) -> Column:
    """(language, path, name, line) of a symbol id: the language ends at the first colon, the line begins after the last @."""
    return F.struct(F.regexp_extract(c, r"^([^:]*):", 1).alias("language"), F.regexp_extract(c, r"^[^:]*:(.*)#", 1).alias("path"), F.regexp_extract(c, r"#([^#]*)@\d+$", 1).alias("name"), F.regexp_extract(c, r"@(\d+)$", 1).try_cast("int").alias("line"))


def source_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, text): the lines of every definition; files is (repo, file, source)."""
    lines = F.split(F.regexp_replace("source", "\r\n?", "\n"), "\n")
    rows = definitions(symbols).select("repo", "file", "id", "line", "end_line").join(files, ["repo", "file"])
    return rows.select("repo", "id", F.array_join(F.slice(lines, F.col("line"), F.col("end_line") - F.col("line") + 1), "\n").alias("text"))


def uses(symbols: DataFrame) -> DataFrame:
    """(repo, file, name, line, src): every reference with the innermost definition around it (null at the top of a file)."""
    d = definitions(symbols).where("end_line > line OR type IN ('function', 'method')").select("repo", "file", F.col("id").alias("src"), F.col("line").alias("from"), F.col("end_line").alias("to"))
    r = references(symbols).distinct()
    inside = r.join(d, (r.repo == d.repo) & (r.file == d.file) & r.line.between(d["from"], d["to"]), "left").select(r.repo, r.file, r.name, r.line, "src", "from", "to")
    order = Window.partitionBy("repo", "file", "name", "line").orderBy((F.col("to") - F.col("from")).asc_nulls_last(), "src")
    return inside.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "from", "to")


def code_graph(symbols: DataFrame) -> DataFrame:
    """(repo, src, dst): from a definition to every definition of a name it refers to, within a repository."""
    u = uses(symbols).where("src IS NOT NULL").select("repo", "src", "name").distinct()
    d = definitions(symbols).select("repo", "name", F.col("id").alias("dst")).distinct()
    return u.join(d, ["repo", "name"]).where("src <> dst").select("repo", "src", "dst").distinct()


def file_edges(symbols: DataFrame) -> DataFrame:
    """(repo, src_file, dst_file): files that refer to other files."""
    path = lambda c: F.regexp_extract(c, r"^[^:]*:(.*)#", 1)
    return code_graph(symbols).select("repo", path("src").alias("src_file"), path("dst").alias("dst_file")).where("src_file <> dst_file").distinct()


def resolved_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, file, name, module, target, id): imports that lead to a definition, by the first candidate file that has it.

    Python: a dotted module from the folder of the file (one folder up for every further leading dot), as module or package. JavaScript
    and TypeScript: relative paths only, with the usual endings or an index. imports is (repo, file, language, name, source, module).
    """
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    dotted = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")))
    python, relative = F.col("language") == "python", F.col("module").rlike(r"^\.\.?/")
    base = resolve_address(F.when(python, dotted).otherwise(F.col("module")), F.col("file"))
    ends = F.when(python, F.array(F.lit(".py"), F.lit("/__init__.py"))).otherwise(F.array(*map(F.lit, (".js", ".jsx", ".ts", ".tsx", "/index.js"))))
    some = imports.where(python | relative & F.col("language").isin("javascript", "typescript", "tsx"))
    each = some.withColumn("base", base).where("base IS NOT NULL").select("repo", "file", "name", "source", "module", "base", F.posexplode(ends).alias("at", "ending")).withColumn("target", F.concat("base", "ending"))
    d = definitions(symbols).select("repo", F.col("file").alias("target"), F.col("name").alias("source"), "id")
    hits = each.join(d, ["repo", "target", "source"])
    return hits.groupBy("repo", "file", "name", "module").agg(F.min(F.struct("at", "target", "id")).alias("b")).select("repo", "file", "name", "module", "b.target", "b.id")


def definition_at(symbols: DataFrame, imports: DataFrame, places: DataFrame) -> DataFrame:
    """(repo, file, line, name, how, id): what a name at a line means: the definition in the innermost scope of its file around it, else
    what it is imported as, else all definitions of that name in the repository. places is (repo, file, line, name)."""
    d = definitions(symbols).select("repo", "file", "name", "id", "parent", F.col("line").alias("from"))
    scope = definitions(symbols).select("repo", "file", F.col("name").alias("parent"), F.col("line").alias("s_from"), F.col("end_line").alias("s_to")).where("parent IS NOT NULL")
    own = places.join(d, ["repo", "file", "name"]).join(scope, ["repo", "file", "parent"], "left")
    own = own.where(F.col("parent").isNull() | F.col("line").between(F.col("s_from"), F.col("s_to")))
    keys = ["repo", "file", "line", "name"]
    local = own.groupBy(*keys).agg(F.min(F.struct(F.coalesce(F.col("s_to") - F.col("s_from"), F.lit(2**31 - 1)).alias("width"), F.col("from"), "id")).alias("b")).select(*keys, F.lit("local").alias("how"), F.col("b.id").alias("id"))
    rest = places.join(local, keys, "left_anti")
    imported = rest.join(resolved_imports(imports, symbols).select("repo", "file", "name", "id"), ["repo", "file", "name"]).select(*keys, F.lit("import"), "id")
    named = rest.join(imported, keys, "left_anti").join(definitions(symbols).select("repo", "name", "id"), ["repo", "name"]).select(*keys, F.lit("name"), "id")
    return local.union(imported).union(named).distinct()


def text_hits(symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, name, file, line, how): where wanted names (repo, name) are used: calls, and whole words on other lines ('text')."""
    calls = references(symbols).join(names, ["repo", "name"], "left_semi").select("repo", "name", "file", "line", F.lit("call").alias("how")).distinct()
    lines = files.where("source IS NOT NULL").select("repo", "file", F.posexplode(F.split(F.regexp_replace("source", "\r\n?", "\n"), "\n")).alias("pos", "text"))
    words = lines.select("repo", "file", (F.col("pos") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), 1))).alias("name"))
    defs = definitions(symbols).select("repo", "name", "file", "line")
    other = words.join(names, ["repo", "name"], "left_semi").join(calls, ["repo", "name", "file", "line"], "left_anti").join(defs, ["repo", "name", "file", "line"], "left_anti")
    return calls.union(other.select("repo", "name", "file", "line", F.lit("text")))


def artifacts_for_symbol(texts: DataFrame, key: str, text: str, symbols: DataFrame) -> DataFrame:
    """(id, key): the documents that cite a symbol literally, for every symbol that is cited and still there."""
    return cited_symbols(texts, key, text, symbols).where("resolves").select("id", "key").distinct()


def god_classes(symbols: DataFrame, methods: int = 15, nloc: int = 200) -> DataFrame:
    """(repo, file, class, methods, nloc): classes with so many methods and code lines."""
    f = definitions(symbols).where("parent IS NOT NULL AND type IN ('function', 'method')").groupBy("repo", "file", F.col("parent").alias("class")).agg(F.count("*").alias("methods"), F.sum(F.coalesce("nloc", F.lit(0))).alias("nloc"))
    return f.where((F.col("methods") >= methods) & (F.col("nloc") >= nloc))


def exported(name: Column, language: Column, parent: Column) -> Column:
    """Whether a definition is visible outside: Go by an upper-case first letter, Python and JavaScript without underscore, others at the top."""
    return F.when(language == "go", name.rlike(r"^\p{Lu}")).when(language.isin("python", "javascript", "typescript", "tsx"), ~name.startswith("_")).otherwise(parent.isNull())


def entry_points(symbols: DataFrame) -> DataFrame:
    d = definitions(symbols)
    return d.where((F.col("name") == "main") | exported(F.col("name"), F.col("language"), F.col("parent"))).select("repo", "id")


def _global(c: str) -> Column:
    return F.concat_ws("|", "repo", c)


def unreachable(symbols: DataFrame) -> DataFrame:
    """Definitions that no entry point reaches along the code graph; test functions and main aside."""
    # a node for every name keeps the graph as large as the references and definitions are, not their product
    name = F.concat_ws("|", F.lit("name"), "repo", "name")
    uses_ = uses(symbols).where("src IS NOT NULL").select(_global("src").alias("src"), name.alias("dst"))
    e = uses_.union(definitions(symbols).select(name.alias("src"), _global("id").alias("dst"))).distinct()
    seen = G.reachable(e, entry_points(symbols).select(_global("id").alias("id")))
    d = definitions(symbols).where("NOT name LIKE 'Test%' AND name <> 'main'").withColumn("key", _global("id"))
    return d.join(seen.select(F.col("id").alias("key")), "key", "left_anti").drop("key")


def name_files(files: DataFrame) -> DataFrame:
    """(repo, name, files): in how many files of a repository a word occurs."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit("([A-Za-z0-9_]+)"), 1)))
    return files.where("source IS NOT NULL").select("repo", "file", words.alias("name")).distinct().groupBy("repo", "name").agg(F.count("*").alias("files"))


def is_test(path: Column) -> Column:
    return path.rlike(r"_test\.go$|(^|/)test_[^/]*\.py$|_test\.py$|Tests?\.java$|\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)(tests?|__tests__)/")


def dead_code(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, id, name, confidence, impact, rank): low in test files, medium if the name occurs in another file, else high; by size."""
    u = unreachable(symbols).select("repo", "file", "id", "name", (F.col("end_line") - F.col("line") + 1).alias("impact"))
    rows = u.join(name_files(files), ["repo", "name"], "left")
    level = F.when(is_test(F.col("file")), "low").when(F.coalesce("files", F.lit(0)) > 1, "medium").otherwise("high")
    return ranked(rows.select("repo", "id", "name", level.alias("confidence"), "impact").distinct(), ["repo"], [F.desc("impact"), F.col("id"), F.col("name")])


def callers(symbols: DataFrame) -> DataFrame:
    """(repo, name, calls, files): how often, and in how many files, a defined name is called."""
    names = definitions(symbols).select("repo", "name").distinct()
    return references(symbols).join(names, ["repo", "name"], "left_semi").groupBy("repo", "name").agg(F.count("*").alias("calls"), F.count_distinct("file").alias("files"))


def will_break(symbols: DataFrame, changed: DataFrame, most: int = 10) -> DataFrame:
    """(repo, name, file, total, rank): files outside the changed ones that refer to a name defined in them; ``most`` listed, all counted."""
    d = definitions(symbols).join(changed, ["repo", "file"], "left_semi").select("repo", "name").distinct()
    r = references(symbols).select("repo", "file", "name").distinct().join(changed, ["repo", "file"], "left_anti").join(d, ["repo", "name"], "left_semi")
    by = Window.partitionBy("repo", "name")
    return r.select("repo", "name", "file", F.count("*").over(by).alias("total"), F.row_number().over(by.orderBy("file")).cast("bigint").alias("rank")).where(F.col("rank") <= most)


# health


def step_severity(value: Column, low: int, medium: int, high: int) -> Column:
    """critical from ``high``, high from ``medium``, medium from halfway between low and medium (whole numbers), else low."""
    return F.when(value >= high, "critical").when(value >= medium, "high").when(value >= low + (medium - low) // 2, "medium").otherwise("low")


def function_findings(symbols: DataFrame) -> DataFrame:
    """(repo, file, function, line, marker, severity) of large, complex, nested, bumpy or overloaded functions."""
    f = definitions(symbols).where("type IN ('function', 'method')")
    n, c, d, b, p = (F.col(x) for x in ("nloc", "ccn", "nesting", "bool_ops", "primitives"))
    mark = lambda cond, name, sev: F.when(cond, F.struct(F.lit(name).alias("marker"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity")))
    marks = F.array_compact(F.array(
        mark((n >= 60) & (c >= 2), "large_method", step_severity(n, 60, 120, 200)), mark(c >= 9, "complex_method", step_severity(c, 9, 15, 25)), mark(d > 4, "nested_complexity", step_severity(d, 5, 6, 8)),
        mark((n >= 70) & (c >= 9), "brain_method", "high"), mark((n >= 40) & (d >= 3), "bumpy_road", "low"), mark(b >= 4, "complex_conditional", step_severity(b, 4, 6, 9)), mark(p > 4, "primitive_obsession", "low"),
        mark(F.col("bad_catch") > 0, "error_handling", "low"), mark(is_test(F.col("file")) & (n >= 50), "large_assertion_block", "low"),
    ))
    return f.select("repo", "file", F.col("name").alias("function"), "line", F.explode(marks).alias("m")).select("repo", "file", "function", "line", "m.marker", "m.severity")


def god_files(symbols: DataFrame) -> DataFrame:
    """Files with 20 top-level definitions or more."""
    top = definitions(symbols).where("parent IS NULL").groupBy("repo", "file").agg(F.count("*").alias("definitions"))
    return top.where("definitions >= 20").withColumn("severity", step_severity(F.col("definitions"), 20, 40, 60))


def clones(files: DataFrame, window: int = 30) -> DataFrame:
    """(repo, file, windows): files with a window of ``window`` folded tokens that another file of the repository has too.

    Identifiers and keywords fold to ``i``, numbers to ``0``, so a token is one character and a window a substring. A window is
    shared if the smallest and the largest file that has it differ, so no group is ever collected. Windows travel as 64-bit hashes
    within their repository (n windows collide with probability n^2 / 2^65).
    """
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace("source", "[A-Za-z_][A-Za-z0-9_]*", "i"), "[0-9]+", "0"), r"\s+", "")
    rows = files.where("source IS NOT NULL").select("repo", "file", folded.alias("t")).where(F.length("t") >= window)
    digests = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - window + 1), lambda i: F.xxhash64(F.substring("t", i, F.lit(window)))))
    each = rows.select("repo", "file", F.explode(digests).alias("digest")).distinct()
    shared = each.groupBy("repo", "digest").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").select("repo", "digest")
    return each.join(shared, ["repo", "digest"], "left_semi").groupBy("repo", "file").agg(F.count("*").alias("windows"))


def lcov(reports: DataFrame, column: str) -> DataFrame:
    """(path, covered, total, rate) of LCOV text."""
    records = reports.select(F.explode(F.split(column, "end_of_record")).alias("r")).select(F.regexp_extract("r", r"SF:([^\r\n]*)", 1).alias("path"), F.regexp_extract_all("r", F.lit(r"DA:\d+,(\d+)"), 1).alias("hits")).where("path <> '' AND size(hits) > 0")
    return records.select("path", F.size(F.filter("hits", lambda h: h.cast("bigint") > 0)).alias("covered"), F.size("hits").alias("total")).withColumn("rate", F.col("covered") / F.col("total"))


def cobertura(reports: DataFrame, column: str) -> DataFrame:
    """(path, covered, total, rate) of Cobertura XML: no line totals there, so of a hundred."""
    each = reports.select(F.explode(F.regexp_extract_all(column, F.lit(r'<class[^>]*filename="[^"]+"[^>]*line-rate="[0-9.]+"'), 0)).alias("c"))
    rows = each.select(F.regexp_extract("c", 'filename="([^"]+)"', 1).alias("path"), F.regexp_extract("c", 'line-rate="([0-9.]+)"', 1).cast("double").alias("rate"))
    return rows.select("path", F.floor(F.col("rate") * 100).cast("int").alias("covered"), F.lit(100).alias("total"), "rate")


#: Neutral constants of the score: deduction by severity, cap a category. Callers inject their own.
DEDUCTIONS = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}
CAP = 4.0


def file_scores(findings: DataFrame, files: DataFrame, deductions: dict = DEDUCTIONS, cap: float = CAP) -> DataFrame:
    """(repo, file, findings, score): 10 minus the deductions, each marker's capped, kept within 1 and 10."""
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(d)) for s, d in deductions.items()], F.lit(0.0))
    per = findings.groupBy("repo", "file", "marker").agg(F.least(F.sum(cost), F.lit(cap)).alias("cost"), F.count("*").alias("n")).groupBy("repo", "file").agg(F.sum("cost").alias("cost"), F.sum("n").alias("findings"))
    out = files.select("repo", "file").distinct().join(per, ["repo", "file"], "left")
    return out.select("repo", "file", F.coalesce("findings", F.lit(0)).alias("findings"), F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 10 - F.coalesce("cost", F.lit(0.0)))), 2).alias("score"))


def kpis(scores: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, files, nloc, mean, worst): the mean score weighted by code lines, at least 1 a file."""
    nloc = definitions(symbols).groupBy("repo", "file").agg(F.sum(F.coalesce("nloc", F.lit(0))).alias("nloc"))
    rows = scores.join(nloc, ["repo", "file"], "left").withColumn("nloc", F.greatest(F.lit(1), F.coalesce("nloc", F.lit(1))))
    return rows.groupBy("repo").agg(F.count("*").alias("files"), F.sum("nloc").alias("nloc"), F.round(F.sum(F.col("score") * F.col("nloc")) / F.sum("nloc"), 2).alias("mean"), F.min("score").alias("worst"))


def mentions(texts: DataFrame, key: str, text: str, files: DataFrame) -> DataFrame:
    """(key, repo, file): files whose path stands literally in a text; path-like tokens are taken out and joined, never searched for."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+)"), 1)))
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), token.alias("file")).join(files.select("repo", "file").distinct(), "file").select("key", "repo", "file").distinct()


def cited_symbols(texts: DataFrame, key: str, text: str, symbols: DataFrame) -> DataFrame:
    """(key, id, resolves): symbol ids that a text cites, and whether they still exist."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:go|java|javascript|python|rust|typescript|tsx):[A-Za-z0-9_./\-]+#[A-Za-z0-9_$]+@[0-9]+)"), 1)))
    cited = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), token.alias("id"))
    known = definitions(symbols).select("id", F.lit(True).alias("known")).distinct()
    return cited.join(known, "id", "left").select("key", "id", F.coalesce("known", F.lit(False)).alias("resolves"))
