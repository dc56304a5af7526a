"""TypeScript and JavaScript sources by a token scanner.

There is no type checker here, so only written types are known. Strings, templates, comments and regular expressions become single tokens,
brackets are matched once, and declarations are read from the tokens of each block.
"""

from __future__ import annotations

import re

from quillmesh.sources.model import collapse, parameter, symbol

TOKEN = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$#][\w$]*)|(?P<mark>=>|\?\.|\.\.\.|[-+*/%&|^!=<>?]=+|&&|\|\||\?\?|[{}()\[\];,.<>:?=@+\-*/%&|^!~])""", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
OPEN, CLOSE = "({[", ")}]"
#: Names that take callbacks worth a symbol, and words that are no callers or references.
TEST_CALLS = ("describe", "it", "test", "before", "after", "beforeEach", "afterEach", "beforeAll", "afterAll", "suite", "specify", "context")
EVENT_CALLS = ("on", "once", "addEventListener", "then", "catch", "finally", "setTimeout", "setInterval", "setImmediate", "nextTick", "action", "use")
KEYWORDS = frozenset("if for while switch catch return function class const let var new typeof await async of in import export from default extends implements interface type enum else do try finally throw case break continue static public private protected readonly abstract get set this super null true false undefined void yield delete instanceof as declare namespace".split())
MODIFIERS = frozenset("export default declare abstract async static public private protected readonly override get set".split())
NESTED_DEPTH, NESTED_LINES = 3, 3


class Token:
    __slots__ = ("kind", "text", "line", "column", "match", "at")

    def __init__(self, kind: str, text: str, line: int, column: int, at: int):
        self.kind, self.text, self.line, self.column, self.at, self.match = kind, text, line, column, at, -1


def tokenize(source: str) -> tuple[list[Token], dict[int, str]]:
    """Tokens with matched brackets, and doc comments by the index of the token after them."""
    out: list[Token] = []
    docs: dict[int, str] = {}
    at, line, start, last = 0, 1, 0, len(source)
    while at < last:
        c = source[at]
        if c == " ":
            at += 1
            continue
        m, text, kind = None, None, None
        if c not in "`/":  # most tokens begin with neither, and names and marks hold no line break
            m = TOKEN.match(source, at)
            if m and m.lastgroup in ("name", "mark", "number"):
                out.append(Token(m.lastgroup, m[0], line, at - start, at))
                at = m.end()
                continue
        if c == "`":
            i, depth = at + 1, 0
            while i < len(source) and (source[i] != "`" or depth):
                if source[i] == "\\":
                    i += 1
                elif source.startswith("${", i):
                    depth += 1
                elif source[i] == "}" and depth:
                    depth -= 1
                i += 1
            text, kind = source[at : i + 1], "string"
        elif c == "/" and not source.startswith(("//", "/*"), at) and (not out or (out[-1].kind == "mark" and out[-1].text not in ")]}") or out[-1].text in ("return", "typeof", "case")):
            m = REGEX.match(source, at)
            text, kind = (m[0], "string") if m else (None, None)
        if text is None:
            m = TOKEN.match(source, at)
            text, kind = (m[0], m.lastgroup) if m else (c, "other")
        if kind == "comment" and text.startswith("/**"):
            docs[len(out)] = text
        elif kind not in ("space", "comment", "other"):
            out.append(Token(kind, text, line, at - start, at))
        breaks = text.count("\n")
        if breaks:
            line, start = line + breaks, at + text.rindex("\n") + 1
        at += len(text)
    held: list[int] = []
    for i, t in enumerate(out):
        if t.kind == "mark" and t.text in OPEN:
            held.append(i)
        elif t.kind == "mark" and t.text in CLOSE and held and OPEN.index(out[held[-1]].text) == CLOSE.index(t.text):
            t.match = held.pop()
            out[t.match].match = i
    return out, docs


class _Tokens(list):
    """Beyond the last token there are empty ones, so unfinished sources need no checks."""

    def __getitem__(self, i):
        try:
            return list.__getitem__(self, i)
        except IndexError:
            if i < 0:
                raise
        return Token("end", "", self[-1].line if self else 1, 0, self[-1].at if self else 0)


class _File:
    def __init__(self, path: str, source: str, language: str):
        self.path, self.source, self.language = path, source, language
        self.lines = source.split("\n")
        tokens, self.docs = tokenize(source)
        self.t, self.words, self.n = _Tokens(tokens), [t.text for t in tokens], len(tokens)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.relations: list[dict] = []
        self.bodies: list[tuple[int, int, str, str]] = []  # of named functions: first and last token, id, name

    def text(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.n else ""

    def slice(self, a: int, b: int) -> str:
        """Source between tokens a and b, b not included, on one line."""
        if a >= b or a >= len(self.t):
            return ""
        last = self.t[min(b, len(self.t)) - 1]
        return re.sub(r"\s+", " ", self.source[self.t[a].at : last.at + len(last.text)]).strip()

    def skip_angles(self, i: int) -> int:
        """The token after <...> that begins at i, or i."""
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.t), i + 400)):
            x = self.text(j)
            depth += (x == "<") - (x == ">")
            if x in (";", "{") and depth > 0 and self.t[j].match < 0:
                return i
            if depth == 0:
                return j + 1
        return i

    def type_end(self, i: int, stops: str) -> int:
        """Where a type that begins at i ends: at a stop mark outside brackets and angles."""
        angle = 0
        while i < len(self.t):
            x = self.t[i]
            if x.kind == "mark" and angle == 0 and x.text in stops and not (x.text == "{" and self.text(i - 1) in (":", "|", "&", "<", "=>", "(")):
                return i
            if x.text == "<":
                angle += 1
            elif x.text == ">" and angle:
                angle -= 1
            i = x.match + 1 if x.text in OPEN and x.match > i else i + 1
        return i

    def parameters(self, a: int) -> list[dict]:
        """Parameters between the brackets that open at a."""
        out, i, end = [], a + 1, self.t[a].match
        while i < end:
            j, angle = i, 0
            while j < end and not (self.text(j) == "," and angle == 0):
                angle += (self.text(j) == "<") - (self.text(j) == ">" and angle > 0)
                j = self.t[j].match + 1 if self.text(j) in OPEN and self.t[j].match > j else j + 1
            k = i
            while self.text(k) in MODIFIERS or self.text(k) == "@":
                k += 2 if self.text(k) == "@" else 1
            rest = self.text(k) == "..."
            k += rest
            name = self.slice(k, self.t[k].match + 1) if self.text(k) in OPEN else self.text(k)
            k = self.t[k].match + 1 if self.text(k) in OPEN else k + 1
            optional = self.text(k) == "?"
            k += optional
            kind = None
            if self.text(k) == ":":
                stop = next((x for x in range(k + 1, j) if self.text(x) == "=" ), j)
                kind, k = self.slice(k + 1, stop), stop
            default = self.text(k) == "="
            if name and name != "this":
                out.append(parameter(name, kind, optional or default, default, rest))
            i = j + 1
        return out

    def function(self, start: int, i: int, name: str, kind: str = "function", **more) -> int:
        """A function whose type or value parameters begin at token i; returns the token after it."""
        i = self.skip_angles(i)
        if self.text(i) != "(" or self.t[i].match < 0:
            return i + 1
        args, i = i, self.t[i].match + 1
        returns = None
        if self.text(i) == ":":
            end = self.type_end(i + 1, "{;=" if kind != "arrow" else "=")
            if kind == "arrow":
                end = next((x for x in range(i + 1, min(len(self.t), i + 200)) if self.text(x) == "=>"), end)
            returns, i = self.slice(i + 1, end), end
        signature_end = i
        if self.text(i) == "=>":
            i += 1
        if self.text(i) == "{" and self.t[i].match > i:
            body, end = i, self.t[i].match
        elif self.text(i - 1) == "=>":
            body, end = i, self.type_end(i, ";,)}") - 1
        else:
            body, end = i, i - (self.text(i) != ";")  # an overload or abstract member has no body
        last = self.t[min(max(end, signature_end - 1), len(self.t) - 1)]
        real = "function" if kind == "arrow" else kind
        row = symbol(
            self.path, self.language, name, real, self.t[start].line, last.line + last.text.count("\n"), signature=self.slice(start, signature_end), return_type=returns, params=self.parameters(args),
            doc=self.docs.get(start), is_generator=self.text(args - 1) == "*" or self.text(args - 2) == "*", **more,
        )
        if row["is_private"] or real != "constructor":
            self.symbols.append(row)
        if end > body:
            caller = f"{row['parent_class']}.{name}" if row.get("parent_class") else name
            self.bodies.append((body, end, row["id"], caller))
            if real in ("function", "method") and row["nesting_depth"] < NESTED_DEPTH and self.text(body) == "{":
                self.block(body + 1, end, name, row["nesting_depth"] + 1)
        return max(end, i) + 1

    def block(self, i: int, end: int, parent: str | None = None, depth: int = 0) -> None:
        """Declarations among the tokens from i to end."""
        while i < end:
            i = max(i + 1, self.statement(i, end, parent, depth))

    def statement(self, i: int, end: int, parent: str | None, depth: int) -> int:
        start, flags = i, set()
        while self.text(i) == "@":  # a decorator
            i = self.skip_call(i + 1)
        if self.text(i) == "import" and parent is None and self.text(i + 1) not in ("(", "."):
            return self.imported(i)
        while self.text(i) in MODIFIERS and self.t[i].kind == "name":
            flags.add(self.text(i))
            i += 1
        if "export" in flags and parent is None and self.text(i) in ("{", "*", "type") and (self.text(i) != "type" or self.text(i + 1) in ("{", "*")):
            return self.exported(i)
        word, name = self.text(i), self.text(i + 1)
        common = {"is_exported": "export" in flags and parent is None, "is_async": "async" in flags}
        if word == "function":
            star = self.text(i + 1) == "*"
            name = self.text(i + 1 + star)
            named = name if name != "(" else "default"
            return self.declare(start, i + 1 + star + (named == name), named, flags, parent, depth, common)
        if word == "class" and parent is None:
            return self.cls(start, i, flags)
        if word == "interface" and parent is None:
            return self.interface(start, i, flags)
        if word == "type" and parent is None and self.t[i + 1].kind == "name" if i + 1 < len(self.t) else False:
            stop = self.type_end(i + 2, ";")
            nxt = next((x for x in range(i + 2, stop) if self.t[x].line > self.t[x - 1].line and self.t[x].kind == "name" and self.text(x) in KEYWORDS and self.text(x - 1) not in ("|", "&", "=")), stop)
            self.add(symbol(self.path, self.language, name, "type", self.t[start].line, self.t[nxt - 1].line, signature=self.slice(start, nxt), doc=self.docs.get(start), is_exported="export" in flags), flags)
            return nxt
        if word == "enum" and parent is None:
            self.add(symbol(self.path, self.language, name, "enum", self.t[start].line, self.t[max(i, self.t[i + 2].match)].line, signature=self.slice(start, i + 2), is_exported="export" in flags), flags)
            return self.t[i + 2].match + 1
        if word in ("const", "let", "var"):
            return self.variable(start, i, flags, parent, depth, common)
        if "default" in flags and self.t[i].kind == "name" if i < len(self.t) else False:
            self.exports.append({"file_path": self.path, "export_name": self.text(i), "is_default": True, "is_re_export": False, "re_export_source": None})
            return i + 1
        if self.t[i].kind == "name" and self.text(i) not in KEYWORDS:
            self.callbacks(i, parent)
        if parent is not None and self.text(i) in OPEN and self.t[i].match > i:
            return self.t[i].match + 1
        return self.t[i].match + 1 if self.text(i) in OPEN and self.t[i].match > i else i + 1

    def skip_call(self, i: int) -> int:
        while self.t[i].kind == "name" or self.text(i) == ".":
            i += 1
        return self.t[i].match + 1 if self.text(i) == "(" else i

    def add(self, row: dict, flags: set) -> None:
        self.symbols.append(row)
        if "export" in flags:
            self.exports.append({"file_path": self.path, "export_name": row["name"], "is_default": "default" in flags, "is_re_export": False, "re_export_source": None})

    def declare(self, start: int, i: int, name: str, flags: set, parent: str | None, depth: int, common: dict, kind: str = "function") -> int:
        before = len(self.symbols)
        full = f"{parent}.{name}" if parent else name
        more = common | {"is_private": name.startswith("_"), "parent_function": parent, "nesting_depth": depth}
        after = self.function(start, i, full, kind, **more)
        own = next((s for s in self.symbols[before:] if s["name"] == full), None)
        if own and parent and own["line_end"] - own["line_start"] + 1 < NESTED_LINES:
            del self.symbols[before:]
        elif own and "export" in flags and parent is None:
            self.exports.append({"file_path": self.path, "export_name": full, "is_default": "default" in flags, "is_re_export": False, "re_export_source": None})
        return after

    def variable(self, start: int, i: int, flags: set, parent: str | None, depth: int, common: dict) -> int:
        name, j = self.text(i + 1), i + 2
        kind = None
        if self.text(j) == ":":
            stop = self.type_end(j + 1, "=;")
            kind, j = self.slice(j + 1, stop), stop
        if self.text(j) == "=" and self.t[i + 1].kind == "name":
            k, is_async = j + 1, self.text(j + 1) == "async"
            k += is_async
            if self.text(k) == "function":
                k += 1 + (self.text(k + 1) == "*")
                k += self.t[k].kind == "name"
                return self.declare(start, k, name, flags, parent, depth, common | {"is_async": is_async})
            head = self.skip_angles(k)
            close = self.t[head].match if self.text(head) == "(" else -1
            arrow = close > 0 and (self.text(close + 1) == "=>" or (self.text(close + 1) == ":" and any(self.text(x) == "=>" for x in range(close + 2, min(close + 40, len(self.t)))) and self.t[close + 1].line == self.t[close].line))
            if arrow:
                return self.declare(start, k, name, flags, parent, depth, common | {"is_async": is_async}, "arrow")
        stop = self.type_end(j, ";")
        line = next((x for x in range(j + 1, stop) if self.t[x].line > self.t[x - 1].line and self.t[x].kind == "name" and self.text(x) in KEYWORDS and self.text(x - 1) not in ("=", ",", "(", "=>")), stop)
        if parent is None and self.t[i + 1].kind == "name":
            end = self.t[max(start, min(line, len(self.t)) - 1)].line
            common = {"signature": self.slice(start, line)[:200], "doc": self.docs.get(start), "is_exported": "export" in flags}
            self.add(symbol(self.path, self.language, name, "variable", self.t[start].line, end, return_type=kind, is_private=name.startswith("_"), **common), flags)
            more = self.type_end(j, ",;")
            while more < line and self.text(more) == "," and self.t[more + 1].kind == "name" and self.text(more + 2) in ("=", ":", ",", ";"):  # further names of one declaration
                name, at, kind = self.text(more + 1), more + 2, None
                if self.text(at) == ":":
                    stop = self.type_end(at + 1, "=,;")
                    kind, at = self.slice(at + 1, stop), stop
                self.add(symbol(self.path, self.language, name, "variable", self.t[more + 1].line, end, return_type=kind, is_private=name.startswith("_"), **common), flags)
                more = self.type_end(at, ",;")
        return line

    def heritage(self, i: int, row_name: str, row_id: str) -> int:
        """extends and implements clauses from token i on; returns the brace that opens the body."""
        kind, begin, angle = None, i, 0

        def close(at: int) -> None:
            if kind and at > begin:
                target = self.slice(begin, at)
                self.relations.append({"file_path": self.path, "source_symbol_id": row_id, "source_name": row_name, "target_name": target, "target_name_base": target.split("<")[0], "relationship_kind": kind})

        while i < len(self.t):
            x = self.text(i)
            if angle == 0 and x in ("extends", "implements", "{", ","):
                close(i)
                if x == "{":
                    return i
                kind, begin = (kind if x == "," else x), i + 1
            angle += (x == "<") - (x == ">" and angle > 0)
            i += 1
        return i

    def cls(self, start: int, i: int, flags: set) -> int:
        name = self.text(i + 1) if self.t[i + 1].kind == "name" and self.text(i + 1) not in ("extends", "implements") else "default"
        row = symbol(self.path, self.language, name, "class", self.t[start].line, self.t[start].line, doc=self.docs.get(start), is_exported="export" in flags, is_abstract="abstract" in flags)
        body = self.heritage(self.skip_angles(i + 2), name, row["id"])
        end = self.t[body].match if body < len(self.t) else -1
        if end < 0:
            return i + 1
        row |= {"line_end": self.t[end].line, "signature": self.slice(start, body)}
        self.add(row, flags)
        self.members(body + 1, end, name)
        return end + 1

    def members(self, i: int, end: int, parent: str) -> None:
        start = i - 1
        while i < end:
            i = max(i, start + 1)
            start, flags = i, set()
            while self.text(i) == "@":
                i = self.skip_call(i + 1)
            while self.text(i) in MODIFIERS and self.text(i + 1) not in ("(", "=", ":", ";", "?"):
                flags.add(self.text(i))
                i += 1
            i += self.text(i) == "*"
            name = self.text(i)
            if i >= end:
                return
            if self.t[i].kind in ("name", "string") or name == "[":
                nxt = max(i, self.t[i].match) + 1 if name == "[" else i + 1
                nxt += self.text(nxt) in ("?", "!")
                more = {"parent_class": parent, "is_static": "static" in flags, "is_async": "async" in flags, "is_abstract": "abstract" in flags, "is_private": "private" in flags or name.startswith("#")}
                if self.text(self.skip_angles(nxt)) == "(":
                    i = self.function(start, nxt, name, "constructor" if name == "constructor" else "method", **more)
                    continue
                stop = self.type_end(nxt, ";")
                line = next((x for x in range(nxt, min(stop, end)) if self.t[x].line > self.t[x - 1].line and self.text(x - 1) not in ("=", "|", "&", ":", "=>", "(")), min(stop, end))
                value = next((x for x in range(nxt, line) if self.text(x) == "="), None)
                k = value + 1 + (self.text(value + 1) == "async") if value else None
                if value and self.text(k) == "(" and self.text(self.t[k].match + 1) in ("=>", ":"):
                    i = self.function(start, k, name, "method", **(more | {"is_async": self.text(value + 1) == "async"}))
                    continue
                self.symbols.append(symbol(self.path, self.language, name, "property", self.t[start].line, self.t[max(start, line - 1)].line, signature=self.slice(start, line)[:200], return_type=self.slice(nxt + 1, value or line) if self.text(nxt) == ":" else None, **more))
                i = line
            else:
                i = self.t[i].match + 1 if name in OPEN and self.t[i].match > i else i + 1

    def interface(self, start: int, i: int, flags: set) -> int:
        name = self.text(i + 1)
        row = symbol(self.path, self.language, name, "interface", self.t[start].line, self.t[start].line, doc=self.docs.get(start), is_exported="export" in flags)
        body = self.heritage(self.skip_angles(i + 2), name, row["id"])
        end = self.t[body].match if body < len(self.t) else -1
        if end < 0:
            return i + 1
        self.add(row | {"line_end": self.t[end].line, "signature": self.slice(start, body)}, flags)
        return end + 1

    def specifiers(self, a: int) -> list[dict]:
        out, end, i = [], self.t[a].match, a + 1
        while i < end:
            i += self.text(i) == "type" and self.text(i + 1) not in (",", "}", "as")
            name, alias = self.text(i), None
            i += 1
            if self.text(i) == "as":
                alias, i = self.text(i + 1), i + 2
            out.append({"name": name, "alias": alias, "is_default": name == "default", "is_namespace": False})
            i += 1
        return out

    def imported(self, i: int) -> int:
        i += 1
        type_only = self.text(i) == "type" and self.text(i + 1) != "from"
        i += type_only
        specifiers = []
        while i < len(self.t) and self.t[i].kind != "string" and self.text(i) != ";":
            if self.text(i) == "*":
                specifiers.append({"name": "*", "alias": self.text(i + 2), "is_default": False, "is_namespace": True})
                i += 3
            elif self.text(i) == "{":
                specifiers += self.specifiers(i)
                i = max(i, self.t[i].match) + 1
            else:
                if self.t[i].kind == "name" and self.text(i) != "from":
                    specifiers.append({"name": self.text(i), "alias": None, "is_default": True, "is_namespace": False})
                i += 1
        if i < len(self.t) and self.t[i].kind == "string":
            self.imports.append({"file_path": self.path, "import_source": self.text(i)[1:-1], "is_type_only": type_only, "is_re_export": False, "specifiers": specifiers})
        return i + 1

    def exported(self, i: int) -> int:
        type_only = self.text(i) == "type"
        i += type_only
        named = self.specifiers(i) if self.text(i) == "{" else [{"name": "*", "alias": self.text(i + 2) if self.text(i + 1) == "as" else None, "is_default": False, "is_namespace": True}]
        i = max(i, self.t[i].match) + 1 if self.text(i) == "{" else i + 1 + 2 * (self.text(i + 1) == "as")
        source = None
        if self.text(i) == "from":
            source, i = self.text(i + 1)[1:-1], i + 2
            self.imports.append({"file_path": self.path, "import_source": source, "is_type_only": type_only, "is_re_export": True, "specifiers": named})
        self.exports += [{"file_path": self.path, "export_name": s["alias"] or s["name"], "is_default": (s["alias"] or s["name"]) == "default", "is_re_export": source is not None, "re_export_source": source} for s in named]
        return i

    def callbacks(self, i: int, parent: str | None) -> None:
        """Functions given to test and event calls, named by their description (S6d)."""
        at = i
        while self.text(at + 1) == ".":
            at += 2
        what = self.text(at)
        if self.text(at + 1) != "(" or what not in TEST_CALLS + EVENT_CALLS or self.t[at + 1].match < 0:
            return
        end, j = self.t[at + 1].match, at + 2
        first = self.text(j)[1:-1] if j < end and self.t[j].kind == "string" else None
        while j < end:
            if self.text(j) == "(" and self.text(self.t[j].match + 1) == "=>" or self.text(j) == "function":
                args = j if self.text(j) == "(" else j + 1 + (self.t[j + 1].kind == "name")
                name = re.sub(r"\W+", "_", first).strip("_")[:60] if first and what in TEST_CALLS else f"{what}_callback_{self.t[j].line}"
                context = f"{what}:{first}" if first and what in ("on", "once", "addEventListener") else what
                self.function(j, args, name or f"{what}_callback_{self.t[j].line}", "callback" if self.text(j) == "function" else "arrow", callback_context=context, is_async=self.text(j - 1) == "async")
                for s in reversed(self.symbols):
                    if s.get("callback_context") == context:
                        s |= {"kind": "callback", "id": f"{self.path}:{s['name']}:callback:{s['line_start']}"}
                        break
                body = self.t[args].match + 2 if self.text(j) == "(" else self.t[args].match + 1
                if self.text(body) == "{" and self.t[body].match > body:
                    for k in range(body + 1, self.t[body].match):
                        if self.t[k].kind == "name" and self.text(k) in TEST_CALLS and self.text(k + 1) == "(":
                            self.callbacks(k, parent)
                return
            j = self.t[j].match + 1 if self.text(j) in OPEN and self.t[j].match > j else j + 1

    def uses(self) -> tuple[list[dict], list[dict]]:
        """References and calls of every identifier."""
        calls, refs = [], []
        declared = {(s["line_start"], s["local_name"]) for s in self.symbols}
        conditional = [(self.t[i].line, self.t[self.t[k].match].line) for i, t in enumerate(self.t) if t.text in ("if", "switch", "catch") and self.text(i + 1) == "(" for k in [self.t[i + 1].match + 1] if self.text(k) == "{" and self.t[k].match > 0]
        owners = sorted(self.bodies)
        imported = {s["alias"] or s["name"] for m in self.imports for s in m["specifiers"]}
        for i, t in enumerate(self.t):
            if t.kind != "name" or t.text in KEYWORDS or len(t.text) < 2:
                continue
            within = [o for o in owners if o[0] <= i <= o[1]]
            owner = max(within, key=lambda o: o[0]) if within else None
            called = self.text(self.skip_angles(i + 1)) == "(" and self.text(i - 1) != "function" and (t.line, t.text) not in declared
            if called and owner:
                calls.append({"file_path": self.path, "caller_symbol_id": owner[2], "caller_name": owner[3], "callee_name": t.text, "is_async": self._awaited(i), "is_conditional": any(a <= t.line <= b for a, b in conditional)})
            if (t.line, t.text) in declared:
                continue
            before, after = self.text(i - 1), self.text(i + 1)
            in_import = self.text(i - 1) in ("import", "{", ",") and t.text in imported and any(x in self.lines[t.line - 1] for x in ("import ", " from "))
            kind = "call" if called else "import" if in_import else "type" if before in ("extends", "implements") or (before == ":" and t.text[:1].isupper()) else "write" if after == "=" else "read"
            line = self.lines[t.line - 1]
            refs.append({"symbol_name": t.text, "referencing_file": self.path, "referencing_symbol_name": owner[3] if owner else None, "line_number": t.line, "column_number": t.column, "context": line[max(0, t.column - 20) : t.column + len(t.text) + 20].strip(), "reference_kind": kind})
        return refs, collapse(calls)

    def _awaited(self, i: int) -> bool:
        while self.text(i - 1) in (".", "?."):
            i -= 2
        return self.text(i - 1) == "await"


def parse(path: str, content: str, language: str = "typescript", wanted: frozenset[str] | None = None) -> dict[str, list[dict]]:
    """Rows by relation; calls and references may be left out."""
    f = _File(path, content, language)
    f.block(0, len(f.t))
    f.symbols = list({s["id"]: s for s in reversed(f.symbols)}.values())[::-1]  # a callback may be met on two ways
    refs, calls = f.uses() if wanted is None or wanted & {"calls", "refs"} else ([], [])
    return {"symbols": f.symbols, "imports": f.imports, "exports": f.exports, "calls": calls, "refs": refs, "type_rels": f.relations}
