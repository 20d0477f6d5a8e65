"""Packrat parsers from parsing-expression grammars.

A grammar is text, one rule a line (continued by indentation)::

    Name <- 'token' Rule (A / B)* C+ D? &ahead !not "word"

'x' is a token of that kind, "x" a plain name with that spelling, EOF the end. Further terminals: WORD (a name or a
keyword), TOKEN (anything but a bracket or the end), NL and NONL (a line break, or none, before the next token), NEVER,
and BEFORE[k ...] (the token just read is of one of those kinds). ``%copy X: A B, C=D`` makes rules XA and XB that refer
to each other and to D in place of C.

Rules become Python functions over the token list: every rule that can be tried twice at one place and calls others
remembers its result at every position, so parsing takes linear time; alternatives are tried only if the next token can begin them. A recogniser is enough here: the result of
``Parser.parse`` is the index of the furthest token at which no alternative could go on, or -1 if all input was consumed.
"""

import re
import sys
from collections import Counter
from dataclasses import dataclass

_ITEM = re.compile(r"""\s*(?:(?P<tok>'[^']+')|(?P<word>"[^"]+")|BEFORE\[(?P<before>[^\]]*(?:\][^\]\s]*)?)\]|(?P<name>[A-Za-z_]\w*)|(?P<op>[()/*+?&!]))""")
_CLOSERS = ("(", ")", "[", "]", "{", "}", "EOF")


def _parse(body: str):
    """The expression tree of a rule: nested tuples, the first element being the operator."""
    items = []
    at = 0
    while body[at:].strip():
        m = _ITEM.match(body, at)
        if not m:
            raise ValueError(f"bad grammar at {body[at:at + 40]!r}")
        items.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()

    def choice(i):
        alts = []
        e, i = seq(i)
        alts.append(e)
        while i < len(items) and items[i] == ("op", "/"):
            e, i = seq(i + 1)
            alts.append(e)
        return (alts[0] if len(alts) == 1 else ("choice", alts)), i

    def seq(i):
        parts = []
        while i < len(items) and items[i] not in (("op", "/"), ("op", ")")):
            e, i = prefix(i)
            parts.append(e)
        return (parts[0] if len(parts) == 1 else ("seq", parts)), i

    def prefix(i):
        if items[i] in (("op", "&"), ("op", "!")):
            e, j = suffix(i + 1)
            return ("and" if items[i][1] == "&" else "not", e), j
        return suffix(i)

    def suffix(i):
        kind, v = items[i]
        if (kind, v) == ("op", "("):
            e, i = choice(i + 1)
            i += 1
        else:
            e, i = (kind, v.strip("'") if kind == "tok" else v.strip('"') if kind == "word" else v), i + 1
        while i < len(items) and items[i] in (("op", "*"), ("op", "+"), ("op", "?")):
            e, i = ({"*": "star", "+": "plus", "?": "opt"}[items[i][1]], e), i + 1
        return e, i

    tree, end = choice(0)
    if end != len(items):
        raise ValueError(f"unbalanced grammar: {body!r}")
    return tree


def _rules(text: str) -> dict[str, object]:
    rules: dict[str, str] = {}
    copies, name = [], None
    for line in text.splitlines():
        line = re.sub(r"(?:^|\s)##.*", "", line)
        if line.startswith("%copy"):
            copies.append(line)
        elif m := re.match(r"(\w+)\s*<-(.*)", line):
            name = m[1]
            rules[name] = m[2]
        elif line.strip():
            rules[name] += " " + line
    for line in copies:
        prefix, names, swaps = re.match(r"%copy (\w+): ([^,]*),?(.*)", line).groups()
        to = {n: prefix + n for n in names.split()} | dict(x.split("=") for x in swaps.split())
        for n in names.split():
            rules[prefix + n] = re.sub(r"""'[^']+'|"[^"]+"|\b[A-Za-z_]\w*\b""", lambda m: to.get(m[0], m[0]), rules[n])
    return {n: _parse(b) for n, b in rules.items()}


def _called(e):
    """The names that an expression mentions, as often as it does."""
    if e[0] == "name":
        yield e[1]
    elif isinstance(e[1], list):
        for x in e[1]:
            yield from _called(x)
    elif isinstance(e[1], tuple):
        yield from _called(e[1])


#: Results are forgotten after so many tokens of whole items: the repetition of the first rule never goes back before one.
WIPE = 20_000
_SPECIAL = {"EOF", "WORD", "TOKEN", "NL", "NONL", "NEVER"}


@dataclass
class _Gen:
    rules: dict
    words: frozenset
    trace: bool

    def __post_init__(self):
        self.lines, self.n, self.sets = [], 0, {}
        self.used = Counter(n for e in self.rules.values() for n in _called(e))
        self.first_ = {n: (frozenset(), False) for n in self.rules}
        while True:
            new = {n: self.first(e) for n, e in self.rules.items()}
            if new == self.first_:
                break
            self.first_ = new

    def first(self, e):
        """(kinds that can begin it, or None for any; whether it can be empty)."""
        kind, v = e
        if kind == "tok":
            return frozenset([v]), False
        if kind == "word":
            return frozenset(["NAME"]), False
        if kind == "name":
            if v in ("NL", "NONL"):
                return frozenset(), True
            if v == "WORD":
                return self.words, False
            if v == "EOF":
                return frozenset(["EOF"]), False
            if v == "NEVER":
                return frozenset(), False
            return (None, False) if v == "TOKEN" else self.first_[v]
        if kind in ("before", "and", "not"):
            return frozenset(), True
        if kind in ("star", "opt"):
            return self.first(v)[0], True
        if kind == "plus":
            return self.first(v)
        out, empty = frozenset(), kind == "seq"
        for x in v:
            f, n = self.first(x)
            out = None if out is None or f is None else out | f
            if kind == "seq" and not n:
                return out, False
            if kind == "choice":
                empty = empty or n
        return out, empty

    def var(self):
        self.n += 1
        return f"v{self.n}"

    def put(self, ind, line):
        self.lines.append("    " * ind + line)

    def test(self, cond, src, dst, ind):
        if self.trace:
            self.put(ind, f"if {cond}: {dst} = {src} + 1")
            self.put(ind, "else:")
            self.put(ind + 1, f"{dst} = -1")
            self.put(ind + 1, f"if {src} > far: far = {src}")
        else:
            self.put(ind, f"{dst} = {src} + 1 if {cond} else -1")

    def gen(self, e, src, dst, ind):
        kind, v = e
        if kind == "tok":
            self.test(f"t[{src}] == {v!r}", src, dst, ind)
        elif kind == "word":
            self.test(f"x[{src}] == {v!r}", src, dst, ind)
        elif kind == "before":
            self.put(ind, f"{dst} = {src} if t[{src} - 1] in {tuple(v.split())!r} else -1")
        elif kind == "name" and v in _SPECIAL:
            if v in ("NL", "NONL"):
                self.put(ind, f"{dst} = {src} if {'not ' * (v == 'NONL')}nl[{src}] else -1")
            elif v == "NEVER":
                self.put(ind, f"{dst} = -1")
            elif v == "EOF":
                self.test(f"t[{src}] == 'EOF'", src, dst, ind)
            elif v == "WORD":
                self.test(f"t[{src}] in WORDS", src, dst, ind)
            else:
                self.test(f"t[{src}] not in {_CLOSERS!r}", src, dst, ind)
        elif kind == "name":
            self.put(ind, f"{dst} = r_{v}({src})")
        elif kind == "seq":
            if not v:
                self.put(ind, f"{dst} = {src}")
                return
            self.put(ind, f"{dst} = -1")
            for k, x in enumerate(v):
                to = dst if k == len(v) - 1 else self.var()
                self.gen(x, src, to, ind)
                if k < len(v) - 1:
                    self.put(ind, f"if {to} >= 0:")
                    ind += 1
                src = to
        elif kind == "choice":
            self.put(ind, f"{dst} = -1")
            for x in v:
                f, empty = self.first(x)
                guard = f" and t[{src}] in {self.set(f)}" if f is not None and not empty and not self.trace else ""
                self.put(ind, f"if {dst} < 0{guard}:")
                self.gen(x, src, dst, ind + 1)
        elif kind in ("star", "plus", "opt"):
            f, empty = self.first(v)
            guard = f"t[{{}}] in {self.set(f)}" if f is not None and not empty and not self.trace else ""
            if kind == "opt":
                if guard:
                    self.put(ind, f"{dst} = {src}")
                    self.put(ind, f"if {guard.format(src)}:")
                    a = self.var()
                    self.gen(v, src, a, ind + 1)
                    self.put(ind + 1, f"if {a} >= 0: {dst} = {a}")
                else:
                    self.gen(v, src, dst, ind)
                    self.put(ind, f"if {dst} < 0: {dst} = {src}")
                return
            if kind == "plus":
                self.gen(v, src, dst, ind)
                self.put(ind, f"if {dst} >= 0:")
                ind += 1
            else:
                self.put(ind, f"{dst} = {src}")
            self.put(ind, f"while {guard.format(dst) or 'True'}:")
            a = self.var()
            self.gen(v, dst, a, ind + 1)
            self.put(ind + 1, f"if {a} <= {dst}: break")
            self.put(ind + 1, f"{dst} = {a}")
            if self.top:
                self.put(ind + 1, f"if {dst} - wiped > {WIPE}: wipe({dst})")
        else:  # and, not
            a = self.var()
            if self.trace:
                self.put(ind, "keep = far")
            self.gen(v, src, a, ind)
            if self.trace:
                self.put(ind, "far = keep")
            self.put(ind, f"{dst} = {src} if {a} {'>=' if kind == 'and' else '<'} 0 else -1")

    def remembered(self, name, e):
        """Whether the results of a rule are kept: not where only one place calls it, nor where it calls no other rule.

        Every cycle of rules is entered from somewhere, so one of its rules has two callers and is kept: the time stays linear.
        """
        return self.used[name] > 1 and any(n not in _SPECIAL for n in _called(e))

    def set(self, f):
        return self.sets.setdefault(f, f"F{len(self.sets)}")

    def source(self, start):
        self.put(0, "def recognise(t, x, nl):")
        self.put(1, "far = wiped = 0")
        kept = [n for n, e in self.rules.items() if self.remembered(n, e)]
        for n in kept:
            self.put(1, f"m_{n} = {{}}")
            self.put(1, f"g_{n} = m_{n}.get")
        self.put(1, f"memos = ({', '.join('m_' + n for n in kept)},)")
        self.put(1, "def wipe(i):")
        self.put(2, "nonlocal wiped")
        self.put(2, "for m in memos: m.clear()")
        self.put(2, "wiped = i")
        for n, e in self.rules.items():
            self.put(1, f"def r_{n}(i):")
            if self.trace:
                self.put(2, "nonlocal far")
            if n in kept:
                self.put(2, f"j = g_{n}(i)")
                self.put(2, "if j is not None: return j")
            self.top = n == start
            self.gen(e, "i", "j", 2)
            if n in kept:
                self.put(2, f"m_{n}[i] = j")
            self.put(2, "return j")
        self.put(1, f"return r_{start}(0), far")
        return "\n".join(self.lines)


class Parser:
    """A grammar, compiled once in the form that only recognises and once in the form that notes the furthest failure."""

    def __init__(self, grammar: str, keywords: frozenset[str], start: str):
        rules, words = _rules(grammar), keywords | {"NAME"}
        known = set(rules) | _SPECIAL

        if missing := {n for e in rules.values() for n in _called(e)} - known:
            raise ValueError(f"no such rules: {sorted(missing)}")
        self._run = []
        for trace in (False, True):
            g = _Gen(rules, words, trace)
            code = g.source(start)
            scope = {"WORDS": words} | {name: f for f, name in g.sets.items()}
            exec(compile(code, f"<grammar {start}>", "exec"), scope)
            self._run.append(scope["recognise"])

    def parse(self, kinds: list[str], texts: list[str], breaks: list[bool], trace: bool = True) -> int:
        if sys.getrecursionlimit() < 60_000:
            sys.setrecursionlimit(60_000)
        if self._run[0](kinds, texts, breaks)[0] >= 0:
            return -1
        if not trace:
            return 0
        return min(self._run[1](kinds, texts, breaks)[1], len(kinds) - 1)
