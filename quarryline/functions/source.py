"""Definitions, references and function metrics of source files in seven languages.

Strings and comments are blanked, then definitions are found by their opening words and closed by their brace (Python: by
indentation). This is an approximation by design: spans and metrics are exact for ordinary code, not for every legal file.
Each file is taken whole, in one pass, without shuffle.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The language of a file ending. (fixed values)
ENDINGS = {"go": "go", "java": "java", "js": "javascript", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx"}
_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRINGS = r'"(?:[^"\\\n]|\\.)*"?' + r"|'(?:[^'\\\n]|\\.)*'?"
_BLANK = {
    "go": re.compile(rf"{_C_LIKE}|`[^`]*`?|{_STRINGS}", re.S), "java": re.compile(rf'{_C_LIKE}|""".*?(?:"""|\Z)|{_STRINGS}', re.S),
    "rust": re.compile(rf'{_C_LIKE}|r#*".*?"#*|"(?:[^"\\]|\\.)*"?' + r"|'(?:[^'\\\n]|\\.[^'\n]*)'", re.S), "python": re.compile(rf"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|{_STRINGS}", re.S),
}
for _l in ("javascript", "typescript", "tsx"):
    _BLANK[_l] = re.compile(rf"{_C_LIKE}|`(?:[^`\\]|\\.)*`?|{_STRINGS}", re.S)
_JS_DEF = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?P<function>function)\s*\*?\s*(?P<n1>[A-Za-z_$][\w$]*)|(?:abstract\s+)?(?P<class>class)\s+(?P<n2>[A-Za-z_$][\w$]*)|(?P<interface>interface)\s+(?P<n3>[A-Za-z_$][\w$]*)|(?P<enum>enum)\s+(?P<n4>\w+)|(?P<type>type)\s+(?P<n5>\w+)[^=\n]*=|(?:const|let|var)\s+(?P<n6>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)[^=;\n]*(?P<arrow>=>))"
_DEFS = {
    "go": r"^(?:(?P<method>func)\s*\([^)]*\)\s*(?P<n1>\w+)|(?P<function>func)\s+(?P<n2>\w+)|type\s+(?P<n3>\w+)\s+(?P<class>struct)|type\s+(?P<n4>\w+)\s+(?P<interface>interface)|(?P<type>type)\s+(?P<n5>\w+))",
    "java": r"^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native|sealed|strictfp)\s+)*(?:(?P<class>class|record)\s+(?P<n1>\w+)|(?P<interface>interface)\s+(?P<n2>\w+)|(?P<enum>enum)\s+(?P<n3>\w+)|(?!return\b|new\b|else\b|throw\b)(?:<[^<>]*>\s*)?[\w.]+(?:<[^;{}()]*>)?(?:\[\])*\s+(?P<n4>\w+)\s*(?P<method>\()(?=[^;{}]*\)\s*(?:throws\s+[\w., ]+)?[{;]))",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*(?:(?P<function>fn)\s+(?P<n1>\w+)|(?P<class>struct|union)\s+(?P<n2>\w+)|(?P<enum>enum)\s+(?P<n3>\w+)|(?P<interface>trait)\s+(?P<n4>\w+)|(?P<type>type)\s+(?P<n5>\w+))",
    "python": r"^[ \t]*(?:async\s+)?(?:(?P<function>def)\s+(?P<n1>\w+)|(?P<class>class)\s+(?P<n2>\w+))",
}
_DEFS = {k: re.compile(v, re.M) for k, v in (_DEFS | {x: _JS_DEF for x in ("javascript", "typescript", "tsx")}).items()}
_CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*!?\(|\.([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch return catch func function def class new sizeof typeof await match fn else elif and or not in is assert print lambda with super self this".split())
_BRANCH = {"python": re.compile(r"\b(?:if|elif|for|while|except|case)\b"), "go": re.compile(r"\b(?:if|for|case)\b"), "rust": re.compile(r"\b(?:if|for|while|loop)\b|=>")}
_BRANCH_C = re.compile(r"\b(?:if|for|while|case|catch)\b|\?(?![.?:])")
_BOOL = {"python": re.compile(r"\b(?:and|or)\b")}
_BOOL_C = re.compile(r"&&|\|\|")
_PRIMITIVE = re.compile(r"\b(?:int|int32|int64|long|short|byte|float|float64|double|bool|boolean|string|str|String|usize|i32|i64|u32|u64|f64|number|char)\b")
_BAD_CATCH = re.compile(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}|\bexcept\s*:|\bexcept\b[^\n:]*:\s*\n?\s*pass\b|\b_\s*=\s*err\b")

_SCHEMA = "kind string, name string, type string, parent string, line int, end_line int, nloc int, ccn int, nesting int, bool_ops int, params int, primitives int, bad_catch int"
_COLUMNS = [c.split() for c in _SCHEMA.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32()}


def blanked(language: str, text: str) -> str:
    """The text with strings and comments as blanks, line breaks kept."""
    return _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def extract(language: str, text: str) -> list[tuple]:
    """Rows of _SCHEMA: definitions with spans and metrics, and references with the line they stand in."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain = blanked(language, text)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    line_of = lambda at: bisect_right(starts, at)
    lines = plain.split("\n")
    defs = []
    for m in _DEFS[language].finditer(plain):
        kind = next(k for k in ("function", "method", "class", "interface", "enum", "type", "arrow") if m.groupdict().get(k))
        name = next(v for k, v in m.groupdict().items() if k[0] == "n" and k[1:].isdigit() and v)
        if name in _NOT_CALLS:
            continue
        first = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
        last = _end_python(lines, first) if language == "python" else line_of(_end_brace(plain, m.end()))
        defs.append(("function" if kind == "arrow" else kind, name, first, last, m.end()))
    rows, at_line = [], {}
    for kind, name, first, last, head in defs:
        parent = None
        for k2, n2, f2, l2, _ in defs:
            if f2 < first and last <= l2 and (parent is None or f2 > parent[1]):
                parent = (n2, f2)
        at_line.setdefault((first, name), True)
        metrics = [None] * 7
        if kind in ("function", "method"):
            own = "\n".join(lines[first - 1 : last])
            opened = plain.find("(", head - 1)
            args = plain[opened + 1 : _close(plain, opened)] if opened >= 0 else ""
            n = 0 if not args.strip() else len(re.split(r",(?![^<\[({]*[>\])}])", args.strip().rstrip(",")))
            if language == "python":
                indents = [len(x) - len(x.lstrip()) for x in lines[first:last] if x.strip()]
                base = min(indents, default=0)
                nesting = max(((i - base) // 4 for i in indents), default=0)
            else:
                depth = nesting = 0
                for c in own:
                    depth += (c == "{") - (c == "}")
                    nesting = max(nesting, depth)
                nesting = max(0, nesting - 1)
            metrics = [sum(1 for x in text.split("\n")[first - 1 : last] if x.strip()), 1 + len(_BRANCH.get(language, _BRANCH_C).findall(own)) + len(_BOOL.get(language, _BOOL_C).findall(own)), nesting, len(_BOOL.get(language, _BOOL_C).findall(own)), n, len(_PRIMITIVE.findall(args)), len(_BAD_CATCH.findall(own))]
        rows.append(("def", name, kind, parent[0] if parent else None, first, last, *metrics))
    for m in _CALL.finditer(plain):
        name, line = m[1] or m[2], line_of(m.start())
        if name not in _NOT_CALLS and (line, name) not in at_line:
            rows.append(("ref", name, None, None, line, line, *[None] * 7))
    return rows


def _close(text: str, at: int) -> int:
    depth = 0
    for i in range(max(at, 0), len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    return len(text)


def _end_brace(text: str, at: int) -> int:
    """Where the braces that open after ``at`` are closed; the end of the line or statement if none opens."""
    depth, n = 0, len(text)
    for m in re.compile(r"[{};\n()]").finditer(text, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif c == ";" and not depth:
            return m.start()
        elif c == "\n" and not depth and not re.compile(r"[ \t\n]*(?:\{|[^\n]*\{)").match(text, m.start()):
            return m.start()
    return n - 1 if n else 0


def _end_python(lines: list[str], first: int) -> int:
    indent = len(lines[first - 1]) - len(lines[first - 1].lstrip())
    last, i = first, first
    while i < len(lines) and not lines[i - 1].rstrip().endswith(":"):
        i += 1
    for j in range(i, len(lines)):
        if lines[j].strip():
            if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                break
            last = j + 1
    return max(last, min(i, len(lines)))


def symbols(df: DataFrame, repo: str, file: str, source: str) -> DataFrame:
    """(repo, file, language, ...) with the columns of _SCHEMA for every definition and reference."""
    ending = F.lower(F.regexp_extract(F.col(file), r"\.([^./\\]+)$", 1))
    rows = df.select(F.col(repo).alias("repo"), F.col(file).alias("file"), ending.alias("ending"), F.col(source).alias("source")).where(F.col("ending").isin(*ENDINGS) & F.col("source").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                at, out = [], []
                for i, (e, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    found = extract(ENDINGS[e], t)
                    at += [i] * len(found)
                    out += found
                take = pa.array(at, pa.int64())
                languages = pa.array([ENDINGS[e] for e in b.column(2).to_pylist()], pa.string())
                cells = list(zip(*out)) if out else [()] * len(_COLUMNS)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), languages.take(take), *(pa.array(c, _ARROW[k]) for c, (_, k) in zip(cells, _COLUMNS))], ["repo", "file", "language", *(n for n, _ in _COLUMNS)])

    return rows.mapInArrow(run, f"repo string, file string, language string, {_SCHEMA}")


_IMPORTS = {
    "python": re.compile(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#;]+))|^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+(\w+))?", re.M),
    "javascript": re.compile(r"\bimport\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\}\s*)?from\s*['\"]([^'\"]+)['\"]|\b(?:const|let|var)\s+(?:([A-Za-z_$][\w$]*)|\{([^}]*)\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"),
}


def imported(language: str, text: str) -> list[tuple[str, str, str, int]]:
    """(name, what it is called in its module, module, line) of the imports of a Python, JavaScript or TypeScript file."""
    rx = _IMPORTS.get("python" if language == "python" else "javascript" if language in ("javascript", "typescript", "tsx") else "")
    out = []
    for m in rx.finditer(text) if rx else ():
        line = text.count("\n", 0, m.start()) + 1
        if language == "python":
            module, names = (m[1], m[2] or m[3]) if m[1] else (m[4], None)
            pairs = [x.split() for x in names.split(",")] if names else [[m[4].rsplit(".", 1)[-1], "as", m[5] or m[4].split(".")[0]]]
        else:
            module = m[3] or m[6]
            names = m[2] or m[5] or ""
            pairs = [re.sub(r"\btype\s|:", lambda x: " as " if x[0] == ":" else " ", x).split() for x in names.split(",")]
            pairs += [["default", "as", n] for n in (m[1], m[4]) if n]
        for p in pairs:
            if p and p[0] != "*":
                out.append((p[2] if len(p) == 3 else p[0], p[0], module, line))
    return out


def imports(df: DataFrame, repo: str, file: str, source: str) -> DataFrame:
    """(repo, file, language, name, source, module, line) of every import."""
    ending = F.lower(F.regexp_extract(F.col(file), r"\.([^./\\]+)$", 1))
    rows = df.select(F.col(repo).alias("repo"), F.col(file).alias("file"), ending.alias("ending"), F.col(source).alias("source")).where(F.col("ending").isin("py", "js", "ts", "tsx") & F.col("source").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            languages = [ENDINGS[e] for e in b.column(2).to_pylist()]
            for i, (language, t) in enumerate(zip(languages, b.column(3).to_pylist())):
                found = imported(language, t)
                at += [i] * len(found)
                out += found
            take = pa.array(at, pa.int64())
            cells = list(zip(*out)) if out else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(languages, pa.string()).take(take), *(pa.array(c, k) for c, k in zip(cells, kinds))], ["repo", "file", "language", "name", "source", "module", "line"])

    return rows.mapInArrow(run, "repo string, file string, language string, name string, source string, module string, line int")
