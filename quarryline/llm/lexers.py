"""Tokens of seven languages: (kinds, texts, line breaks before, places), or the place where no token can begin."""

import re

Tokens = tuple[list[str], list[str], list[bool], list[int]]


class LexError(Exception):
    def __init__(self, place: int, what: str):
        super().__init__(what)
        self.place, self.what = place, what


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Reserved words of each language. (fixed values)
GO = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
JAVA = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void "
    "volatile while true false null"
)
JS = _words(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super "
    "switch this throw true try typeof var void while with let static yield await"
)
PYTHON = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield"
)
RUST = _words("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn")

_NAME = r"[^\W\d]\w*"
_WHOLE = r"[^\W\d]\w*+"


def _master(*parts: tuple[str, str], lead: str = "") -> re.Pattern:
    """One pattern for all tokens, each a named group; ``lead`` is what may stand before a token and is no part of it."""
    tokens = "|".join(f"(?P<{n}>{p})" for n, p in parts)
    return re.compile(f"{lead}(?:{tokens})" if lead else tokens, re.S)


def _ops(text: str) -> str:
    """The operators, those first with whose character no other one begins."""
    ops = text.split()
    alone = [o for o in ops if len(o) == 1 and sum(x[0] == o for x in ops) == 1]
    rest = sorted((o for o in ops if o not in alone), key=len, reverse=True)
    return "|".join([f"[{''.join(map(re.escape, alone))}]", *map(re.escape, rest)])


_GO = _master(
    ("NAME", _NAME), ("BREAK", r"\n\s*"), ("LINE", r"//[^\n]*"), ("BLOCK", r"/\*.*?\*/"),
    ("NUM", r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[\d_]+)?i?(?!\w)|0[bB][01_]+i?(?!\w)|0[oO][0-7_]+i?(?!\w)|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?i?(?!\w)"),
    ("STR", r'"(?:[^"\\\n]|\\[abfnrtv\\"]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{3})*"|`[^`]*`'),
    ("CHAR", r"'(?:[^'\\\n]|\\[abfnrtv\\']|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{3})'"),
    ("OP", _ops("<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~")), ("LAST", r"\Z"), lead=r"[ \t\r]*",
)
_GO_ENDS = frozenset("NAME NUM STR CHAR break continue fallthrough return ++ -- ) ] }".split())


def go(text: str) -> Tokens:
    kinds, texts, nl, at = [], [], [], []
    i, broken = 1 if text.startswith("﻿") else 0, False

    def end(place: int) -> None:
        nonlocal broken
        if not broken and kinds and kinds[-1] in _GO_ENDS:
            kinds.append(";")
            texts.append("\n")
            nl.append(False)
            at.append(place)
        broken = True

    match, n = _GO.match, len(text)
    put_kind, put_text, put_nl, put_at = kinds.append, texts.append, nl.append, at.append
    while i < n:
        m = match(text, i)
        if not m:
            raise LexError(re.compile(r"[ \t\r]*").match(text, i).end(), "no token")
        kind = m.lastgroup
        start, i = m.span(kind)
        if kind == "BREAK":
            if not broken:
                end(start)
        elif kind == "LINE" or kind == "LAST":
            pass
        elif kind == "BLOCK":
            if "\n" in m[kind]:
                end(start)
        else:
            s = m[kind]
            put_kind(s if kind == "OP" or s in GO else "NUM" if kind == "CHAR" else kind)
            put_text(s)
            put_nl(broken)
            put_at(start)
            broken = False
    end(n)
    kinds.append("EOF")
    texts.append("")
    nl.append(True)
    at.append(n)
    return kinds, texts, nl, at


def _plain(master: re.Pattern, keywords: frozenset[str]):
    """A lexer for a language without modes; '>' is always a token of its own."""

    def lex(text: str) -> Tokens:
        kinds, texts, nl, at = [], [], [], []
        i, n, match, broken = 1 if text.startswith("﻿") else 0, len(text), master.match, False
        put_kind, put_text, put_nl, put_at = kinds.append, texts.append, nl.append, at.append
        while i < n:
            m = match(text, i)
            if not m:
                raise LexError(i, "no token")
            kind = m.lastgroup
            start, end = m.span(kind)
            if kind == "SPACE":
                broken = broken or text.find("\n", start, end) >= 0
            else:
                s = m[kind]
                put_kind(s if kind == "OP" or s in keywords else kind)
                put_text(s)
                put_nl(broken)
                put_at(start)
                broken = False
            i = end
        kinds.append("EOF")
        texts.append("")
        nl.append(True)
        at.append(n)
        return kinds, texts, nl, at

    return lex


_NUM = (
    r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[\d_]+)?[lLfFdD]?(?!\w)|0[bB][01_]+[lL]?(?!\w)|\d[\d_]*\.(?!\.)[\d_]*(?:[eE][+-]?[\d_]+)?[fFdD]?(?!\w)"
    r"|\.\d[\d_]*(?:[eE][+-]?[\d_]+)?[fFdD]?(?!\w)|\d[\d_]*(?:[eE][+-]?[\d_]+[fFdD]?|[fFdD])(?!\w)|(?:0[0-7_]*|[1-9][\d_]*)[lL]?(?!\w)"
)
_JAVA = _master(
    ("NAME", r"(?:[^\W\d]|\$)[\w$]*"), ("SPACE", r"(?:[ \t\r\n\f]+|//[^\n]*|/\*.*?\*/)+|\x1a\Z"), ("NUM", _NUM),
    ("STR", r'"""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\[btnfrs"\'\\]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3})*"|""(?!")'),
    ("CHAR", r"'(?:[^'\\\n]|\\[btnfrs\"'\\]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3})'"),
    ("OP", _ops("... -> :: ++ -- && || == != <= += -= *= /= &= |= ^= %= <<= << @ ( ) { } [ ] ; , . = > < ! ~ ? : + - * / & | ^ %")), lead=" ?",
)
java = _plain(_JAVA, JAVA)

_RUST_SKIP = re.compile(r"(?:[ \t\r\n\f]+|//[^\n]*)*")
_RUST = _master(
    ("NAME", r"(?:[^\W\d]|_)\w*+(?![\"'#])"), ("P", r"[()\[\]{},;]"),
    ("STR", r'[bc]?"(?:[^"\\]|\\.)*"|[bc]?r(?P<h>#*)".*?"(?P=h)'),
    ("CHAR", r"b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'"), ("LIFE", r"'(?:[^\W\d]|_)\w*"),
    ("NAME2", r"r#[^\W\d]\w*|(?:[^\W\d]|_)\w*"),
    ("NUM", r"0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0o[0-7_]+(?:[iu]\w+)?(?!\w)|0b[01_]+(?:[iu]\w+)?(?!\w)|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))"),
    ("OP", _ops("..= ... .. :: -> => && || == != <= += -= *= /= %= ^= &= |= <<= << + - * / % ^ ! & | = > < @ . , ; : # $ ? ~ ( ) [ ] { }")),
)


def rust(text: str) -> Tokens:
    kinds, texts, nl, at = [], [], [], []
    i, n = 1 if text.startswith("﻿") else 0, len(text)
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        i = text.find("\n") if "\n" in text else n
    match, skip = _RUST.match, _RUST_SKIP.match
    while i < n:
        i = skip(text, i).end()
        if i >= n:
            break
        if text[i] == "/" and text.startswith("/*", i):
            depth, j = 1, i + 2
            for m in re.compile(r"/\*|\*/").finditer(text, j):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    j = m.end()
                    break
            if depth:
                raise LexError(i, "open comment")
            i = j
            continue
        m = match(text, i)
        if not m:
            raise LexError(i, "no token")
        kind, s = m.lastgroup, m[0]
        if kind == "h":
            kind = "STR"
        elif kind == "NAME2":
            kind = "NAME"
        kinds.append(s if kind == "P" or kind == "OP" or s in RUST else "NUM" if kind == "CHAR" else kind)
        texts.append(s)
        nl.append(False)
        at.append(i)
        i = m.end()
    kinds.append("EOF")
    texts.append("")
    nl.append(True)
    at.append(n)
    return kinds, texts, nl, at


_JS_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r]*|/\*.*?\*/)+", re.S)
_JS = _master(
    ("NAME", r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4})*"),
    ("NUM", r"0[xX][0-9a-fA-F_]+n?(?![\w$])|0[bB][01_]+n?(?![\w$])|0[oO][0-7_]+n?(?![\w$])|(?:\d[\d_]*n(?![\w$])|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?![\w$]))"),
    ("STR", r'"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|' + r"'(?:[^'\\\n\r]|\\(?:\r\n|.))*'"),
    ("PRIVATE", r"#[^\W\d][\w$]*"),
    ("OP", r"\?\.(?!\d)|" + _ops("... => === !== == != <= ** ++ -- && || ?? += -= *= /= %= &= |= ^= **= &&= ||= ??= <<= << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = @ .")),
)
#: White space, then a name (not before an escape) or one of the marks that are always a token of their own.
_JS_QUICK = re.compile(r"([ \t\r\n]*)((?:[^\W\d]|\$)[\w$]*+(?![\\\u200c\u200d])|[()\[\],;:])")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: After these a slash divides and a ``<`` compares.
_JS_VALUES = frozenset("NAME NUM STR PRIVATE TEMPLATE REGEX ) ] } this super null true false".split())
_JSX_NAME = re.compile(r"[^\W\d][\w$\-]*")


def _js(jsx: bool):
    def lex(text: str) -> Tokens:
        kinds, texts, nl, at = [], [], [], []
        n = len(text)
        pos = 1 if text.startswith("﻿") else 0
        if text.startswith("#!", pos):
            pos = len(text.splitlines()[0])
        broken = False

        def put(kind: str, s: str, place: int) -> None:
            nonlocal broken
            kinds.append(kind)
            texts.append(s)
            nl.append(broken)
            at.append(place)
            broken = False

        def skip(i: int) -> int:
            nonlocal broken
            m = _JS_SPACE.match(text, i)
            if m:
                broken = broken or "\n" in m[0] or "\r" in m[0]
                return m.end()
            return i

        def template(i: int) -> int:
            """From after the opening back-tick; the parts between are tokens of their own."""
            put("`", "`", i - 1)
            while True:
                i = _JS_TEMPLATE.match(text, i).end()
                if i >= n:
                    raise LexError(n, "open template")
                if text[i] == "`":
                    put("`end", "`", i)
                    return i + 1
                put("${", "${", i)
                i = code(i + 2, "}")
                kinds[-1] = "}$"

        def tag(i: int) -> int:
            """An element, from its ``<``."""
            put("J<", "<", i)
            i, name = jsx_name(i + 1)
            while True:
                i = skip(i)
                if text.startswith("/>", i):
                    put("J/>", "/>", i)
                    return i + 2
                if text.startswith(">", i):
                    put("J>", ">", i)
                    i += 1
                    break
                if text.startswith("{", i):
                    put("J{", "{", i)
                    i = code(i + 1, "}")
                    kinds[-1] = "J}"
                elif m := re.compile(r"[^\W\d][\w$\-:]*").match(text, i):
                    put("JNAME", m[0], i)
                    i = skip(m.end())
                    if text.startswith("=", i):
                        put("J=", "=", i)
                        i = skip(i + 1)
                        if text[i : i + 1] in ("'", '"'):
                            j = text.find(text[i], i + 1)
                            if j < 0:
                                raise LexError(i, "open string")
                            put("STR", text[i : j + 1], i)
                            i = j + 1
                        elif text.startswith("{", i):
                            put("J{", "{", i)
                            i = code(i + 1, "}")
                            kinds[-1] = "J}"
                        else:
                            raise LexError(i, "no value")
                else:
                    raise LexError(min(i, n), "bad tag")
            while True:
                j = i
                while j < n and text[j] not in "<{>}":
                    j += 1
                if j >= n:
                    raise LexError(n, "open tag")
                if text[j] in ">}":
                    raise LexError(j, "bad text")
                if text[i:j].strip():
                    put("JTEXT", text[i:j], i)
                i = j
                if text[i] == "{":
                    put("J{", "{", i)
                    i = code(i + 1, "}")
                    kinds[-1] = "J}"
                elif text.startswith("</", i):
                    put("J</", "</", i)
                    j, other = jsx_name(i + 2)
                    if other != name:
                        raise LexError(i + 2, "tag mismatch")
                    j = skip(j)
                    if not text.startswith(">", j):
                        raise LexError(min(j, n), "bad tag")
                    put("J>", ">", j)
                    i = j + 1
                    return i
                else:
                    i = tag(i)

        def jsx_name(i: int) -> tuple[int, str]:
            i, name = skip(i), ""
            while m := _JSX_NAME.match(text, i):
                put("JNAME", m[0], i)
                name += m[0]
                i = m.end()
                if text[i : i + 1] in (".", ":") and _JSX_NAME.match(text, i + 1):
                    put("J.", text[i], i)
                    name += text[i]
                    i += 1
                else:
                    break
            return i, name

        quick = _JS_QUICK.match

        def code(i: int, until: str | None) -> int:
            nonlocal broken
            depth = 0
            while True:
                m = quick(text, i)
                while m:  # names and marks without a second meaning
                    start, end = m.span(2)
                    if end < 0:
                        break
                    s = m[2]
                    if start > i and not broken:
                        broken = "\n" in m[1] or "\r" in m[1]
                    kinds.append(s if s in "()[],;:" or s in JS and not (kinds and kinds[-1] in (".", "?.")) else "NAME")
                    texts.append(s)
                    nl.append(broken)
                    at.append(start)
                    broken = False
                    i = end
                    m = quick(text, i)
                i = skip(i)
                if i >= n:
                    if until:
                        raise LexError(n, "open brace")
                    return i
                c = text[i]
                value = kinds and kinds[-1] in _JS_VALUES
                if c == "`":
                    i = template(i + 1)
                    continue
                if c == "/" and not value and (m := _JS_REGEX.match(text, i)):
                    put("REGEX", m[0], i)
                    i = m.end()
                    continue
                if jsx and c == "<" and (not value or kinds[-1] == "}" ) and re.compile(r"<\s*(?:>|[A-Za-z_$][\w$\-.:]*(?!\s*(?:,|extends\b|=[^{\"'\s]))\s*(?:[/>{]|[A-Za-z_$]))").match(text, i):
                    i = tag(i)
                    kinds[-1] = "J>!" if kinds[-1] == "J>" else "J/>!"
                    continue
                m = _JS.match(text, i)
                if not m:
                    raise LexError(i, "no token")
                kind, s = m.lastgroup, m[0]
                if kind == "OP":
                    if s == "{":
                        depth += 1
                    elif s == "}":
                        if until and not depth:
                            put("}", s, i)
                            return i + 1
                        depth -= 1
                    kind = s
                elif s in JS and not (kinds and kinds[-1] in (".", "?.")):
                    kind = s
                put(kind, s, i)
                i = m.end()

        code(pos, None)
        put("EOF", "", n)
        nl[-1] = True
        return kinds, texts, nl, at

    return lex


javascript = _js(False)
typescript = _js(False)
tsx = _js(True)

_PY_PREFIX = r"(?:[rR]|[bB]|[rR][bB]|[bB][rR]|[uU]|[fF]|[fF][rR]|[rR][fF])?"
_PY = _master(
    ("NAME", _WHOLE + r"(?![\"'])"), ("P", r"[()\[\],]"), ("BREAK", r"\r\n|\n|\r"), ("COMMENT", r"#[^\n\r]*"),
    ("STR", _PY_PREFIX + r'(?:"""(?:[^"\\]|\\.|"(?!""))*"""|' + r"'''(?:[^'\\]|\\.|'(?!''))*'''|" + r'"(?:[^"\\\n\r]|\\(?:\r\n|.))*"(?!")|""(?!")|' + r"'(?:[^'\\\n\r]|\\(?:\r\n|.))*'(?!')|''(?!'))"),
    ("NUM", r"0[xX](?:_?[0-9a-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?!\w)"),
    ("NAME2", _NAME), ("OP", _ops("**= //= >>= <<= ... != -> += -= *= /= %= &= |= ^= @= := == <= >= << >> ** // + - * / % & | ^ ~ < > ( ) [ ] { } , : . ; = @")),
    ("LAST", r"\Z"), lead=r"(?:[ \t\f]+|\\\r?\n|\\\r)*",
)


_F_OPEN = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|'''|[\"'])")
_F_NEXT = re.compile(r"[\[\](){}:#\"'\n]|!=")


def _f_string(text: str, i: int) -> int:
    """The end of a formatted string that begins at ``i``: its fields may hold strings with the same quotes."""
    m = _F_OPEN.match(text, i)
    quote, j, n = m[1], m.end(), len(text)
    while True:
        if text.startswith(quote, j):
            return j + len(quote)
        c = text[j : j + 1]
        if not c or c in "\r\n" and len(quote) == 1:
            raise LexError(min(j, n), "open string")
        if c == "\\":
            j += 2
        elif c in "{}":
            if text.startswith(c * 2, j):
                j += 2
            elif c == "}":
                raise LexError(j, "closing brace")
            else:
                j = _f_field(text, j + 1, quote)
        else:
            j += 1


def _f_field(text: str, j: int, quote: str) -> int:
    """The place after the ``}`` of a field whose expression begins at ``j``."""
    depth, start = 0, j
    while True:
        m = _F_NEXT.search(text, j)
        if not m:
            raise LexError(len(text), "open string")
        c, j = m[0], m.end()
        if c in "\"'":
            at = m.start()
            while at > start and text[at - 1].isalpha() and at > m.start() - 2:
                at -= 1
            if (inner := _F_OPEN.match(text, at)) or (inner := _F_OPEN.match(text, at + 1)):
                j = _f_string(text, inner.start())
            else:
                inner = _PY.match(text, m.start())
                if not inner or inner.lastgroup != "STR":
                    raise LexError(m.start(), "open string")
                j = inner.end()
        elif c in "([{":
            depth += 1
        elif c == "}" and not depth:
            if not text[start : m.start()].strip():
                raise LexError(m.start(), "empty field")
            return j
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                raise LexError(m.start(), "closing bracket")
        elif c == ":" and not depth and "lambda" not in text[start : m.start()]:
            while not text.startswith("}", j):  # a format, which may hold fields
                if j >= len(text) or text[j] == "\n" and len(quote) == 1 or text.startswith(quote, j):
                    raise LexError(j, "open string")
                j = _f_field(text, j + 1, quote) if text[j] == "{" else j + 1
            return j + 1
        elif c == "#":
            j = text.find("\n", j)
            if j < 0:
                raise LexError(len(text), "open string")


def python(text: str) -> Tokens:
    kinds, texts, nl, at = [], [], [], []
    i, n = 1 if text.startswith("﻿") else 0, len(text)
    stack: list[tuple[int, int]] = [(0, 0)]
    depth, fresh, match = 0, True, _PY.match
    put_kind, put_text, put_nl, put_at = kinds.append, texts.append, nl.append, at.append
    if "\0" in text:
        raise LexError(text.index("\0"), "null character")

    def put(kind: str, s: str, place: int) -> None:
        kinds.append(kind)
        texts.append(s)
        nl.append(False)
        at.append(place)

    while i < n:
        if fresh and not depth:
            j = i
            column = other = 0
            while j < n and text[j] in " \t\f":
                if text[j] == "\t":
                    column, other = column // 8 * 8 + 8, other + 1
                elif text[j] == "\f":
                    column = other = 0
                else:
                    column, other = column + 1, other + 1
                j += 1
            i = j
            if i >= n:
                break
            if text[i] not in "#\r\n":
                if text[i] == "\\" and re.compile(r"\\\r?\n").match(text, i):
                    pass
                elif column > stack[-1][0]:
                    if other <= stack[-1][1]:
                        raise LexError(i, "tabs and blanks")
                    stack.append((column, other))
                    put("INDENT", "", i)
                else:
                    while column < stack[-1][0]:
                        stack.pop()
                        put("DEDENT", "", i)
                    if column != stack[-1][0]:
                        raise LexError(i, "dedent")
                    if other != stack[-1][1]:
                        raise LexError(i, "tabs and blanks")
            fresh = False
            continue
        m = match(text, i)
        if not m:
            raise LexError(re.compile(r"(?:[ \t\f]+|\\\r?\n|\\\r)*").match(text, i).end(), "no token")
        kind = m.lastgroup
        start, i = m.span(kind)
        if (kind == "STR" or kind == "NAME2") and _F_OPEN.match(text, start):
            i, kind = _f_string(text, start), "STR"
            put("STR", text[start:i], start)
        elif kind == "BREAK":
            if not depth:
                if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    put("NEWLINE", m[kind], start)
                fresh = True
        elif kind == "COMMENT" or kind == "LAST":
            pass
        else:
            s = m[kind]
            if kind == "NAME" or kind == "NAME2":
                kind = s if s in PYTHON else "NAME"
            elif kind == "OP" or kind == "P":
                if s in "([{":
                    depth += 1
                elif s in ")]}":
                    depth -= 1
                    if depth < 0:
                        raise LexError(start, "closing bracket")
                kind = s
            elif kind == "NUM" and re.match(r"0[\d_]*[1-9]", s) and re.fullmatch(r"[\d_]+", s):
                raise LexError(start, "leading zero")
            put_kind(kind)
            put_text(s)
            put_nl(False)
            put_at(start)
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        put("NEWLINE", "", n)
    for _ in stack[1:]:
        put("DEDENT", "", n)
    put("EOF", "", n)
    return kinds, texts, nl, at
