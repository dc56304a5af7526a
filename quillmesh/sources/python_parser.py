"""Python sources by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from quillmesh.sources.model import collapse, parameter, symbol


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _parameters(args: ast.arguments) -> list[dict]:
    out = []
    plain = [*args.posonlyargs, *args.args]
    first_default = len(plain) - len(args.defaults)
    for i, a in enumerate(plain):
        if i == 0 and a.arg in ("self", "cls"):
            continue
        out.append(parameter(a.arg, _text(a.annotation), i >= first_default, i >= first_default))
    if args.vararg:
        out.append(parameter("*" + args.vararg.arg, _text(args.vararg.annotation), rest=True))
    out += [parameter(a.arg, _text(a.annotation), d is not None, d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    if args.kwarg:
        out.append(parameter("**" + args.kwarg.arg, _text(args.kwarg.annotation), rest=True))
    return out


def _exported(name: str) -> bool:
    return not name.startswith("_") or (name.startswith("__") and name.endswith("__"))


class _File:
    def __init__(self, path: str, content: str, wanted: frozenset[str] | None = None):
        self.path, self.lines, self.wanted = path, content.split("\n"), wanted
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.relations: list[dict] = []
        self.calls: list[dict] = []
        self.refs: list[dict] = []
        self.tree = ast.parse(content)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> None:
        decorators = [ast.unparse(d) for d in node.decorator_list]
        is_async = isinstance(node, ast.AsyncFunctionDef)
        kind = "function" if parent is None else "constructor" if node.name == "__init__" else "method"
        returns = _text(node.returns)
        signature = f"{'async ' if is_async else ''}def {node.name}({ast.unparse(node.args)}){' -> ' + returns if returns else ''}"
        row = symbol(
            self.path, "python", node.name, kind, node.lineno, node.end_lineno, signature=signature, parent_class=parent, is_async=is_async, is_exported=_exported(node.name),
            is_private=node.name.startswith("_") and not node.name.startswith("__"), is_static="staticmethod" in decorators, is_abstract=any("abstractmethod" in d for d in decorators),
            is_generator=any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in ast.walk(node)), return_type=returns, doc=ast.get_docstring(node), params=_parameters(node.args),
        )
        self.symbols.append(row)
        if self.wanted is None or "calls" in self.wanted:
            self._calls(node, row["id"], f"{parent}.{node.name}" if parent else node.name)

    def _calls(self, node: ast.AST, caller: str, name: str) -> None:
        def walk(n: ast.AST, awaited: bool, conditional: bool) -> None:
            if isinstance(n, ast.Call):
                callee = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
                if callee:
                    self.calls.append({"file_path": self.path, "caller_symbol_id": caller, "caller_name": name, "callee_name": callee, "is_async": awaited, "is_conditional": conditional})
            for child in ast.iter_child_nodes(n):
                walk(child, isinstance(n, ast.Await), conditional or isinstance(n, (ast.If, ast.IfExp, ast.Match, ast.Try, ast.While)))

        for child in node.body:
            walk(child, False, False)

    def cls(self, node: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in node.bases]
        row = symbol(self.path, "python", node.name, "class", node.lineno, node.end_lineno, signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), is_exported=_exported(node.name), is_private=node.name.startswith("_"), is_abstract=any(b.endswith("ABC") for b in bases), doc=ast.get_docstring(node))
        self.symbols.append(row)
        for i, b in enumerate(bases):
            self.relations.append({"file_path": self.path, "source_symbol_id": row["id"], "source_name": node.name, "target_name": b, "target_name_base": b.split("[")[0], "relationship_kind": "mixin" if i else "extends"})
        for child in node.body:
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(child, node.name)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                self.variable(child, node.name)

    def variable(self, node: ast.Assign | ast.AnnAssign, parent: str | None) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        for t in targets:
            if isinstance(t, ast.Name) and not (parent is None and t.id == "__all__"):
                self.symbols.append(symbol(self.path, "python", t.id, "property" if parent else "variable", node.lineno, node.end_lineno, signature=ast.unparse(node)[:200], parent_class=parent, is_static=parent is not None, is_exported=_exported(t.id), is_private=t.id.startswith("_"), return_type=_text(getattr(node, "annotation", None))))

    def imported(self, node: ast.Import | ast.ImportFrom) -> None:
        row = {"file_path": self.path, "is_type_only": False, "is_re_export": False}
        if isinstance(node, ast.Import):
            self.imports += [row | {"import_source": a.name, "specifiers": [{"name": a.name, "alias": a.asname, "is_default": False, "is_namespace": True}]} for a in node.names]
        else:
            self.imports.append(row | {"import_source": "." * node.level + (node.module or ""), "specifiers": [{"name": a.name, "alias": a.asname, "is_default": False, "is_namespace": a.name == "*"} for a in node.names]})

    def references(self) -> None:
        owner: list[tuple[int, int, str]] = [(s["line_start"], s["line_end"], s["name"]) for s in self.symbols if s["kind"] in ("function", "method", "constructor")]
        called = {id(n.func) for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        for n in ast.walk(self.tree):
            name, kind = (n.id, "write" if isinstance(n.ctx, ast.Store) else "read") if isinstance(n, ast.Name) else (n.attr, "write" if isinstance(n.ctx, ast.Store) else "read") if isinstance(n, ast.Attribute) else (None, None)
            if name is None or len(name) < 2 or name in ("self", "cls"):
                continue
            line = self.lines[n.lineno - 1]
            within = [o for o in owner if o[0] <= n.lineno <= o[1]]
            self.refs.append({
                "symbol_name": name, "referencing_file": self.path, "referencing_symbol_name": max(within)[2] if within else None, "line_number": n.lineno, "column_number": n.col_offset,
                "context": line[max(0, n.col_offset - 20) : n.col_offset + len(name) + 20].strip(), "reference_kind": "call" if id(n) in called else kind,
            })

    def exports(self) -> list[dict]:
        for node in self.tree.body:
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                names = [e.value for e in node.value.elts if isinstance(e, ast.Constant)]
                break
        else:
            names = [s["name"] for s in self.symbols if s["parent_class"] is None and not s["name"].startswith("_")] if self.symbols else []
        return [{"file_path": self.path, "export_name": n, "is_default": False, "is_re_export": False, "re_export_source": None} for n in dict.fromkeys(names)]


REPAIRS = 50


def mended(content: str) -> str | None:
    """The source without what has errors in its syntax, on the same lines: the innermost definition around each error becomes `pass`, or else its line goes. None if that doesn't help."""
    lines = content.split("\n")
    indent = lambda x: len(x) - len(x.lstrip())
    for _ in range(REPAIRS):
        try:
            ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max(0, (e.lineno or 1) - 1), len(lines) - 1)
            while at and not lines[at].strip():
                at -= 1
            first, own = at, indent(lines[at])
            while first >= 0 and not (re.match(r"\s*(async\s+def|def|class)\b", lines[first]) and (first == at or indent(lines[first]) < own)):
                first -= 1
            if first < 0:
                first, last = at, at + 1
            else:
                last = first + 1
                while last < len(lines) and (not lines[last].strip() or indent(lines[last]) > indent(lines[first])):
                    last += 1
                last = max(last, at + 1)
            lines[first:last] = [" " * indent(lines[first]) + "pass"] + [""] * (last - first - 1)
            continue
        return "\n".join(lines)
    return None


def parse(path: str, content: str, wanted: frozenset[str] | None = None) -> dict[str, list[dict]]:
    """Rows by relation; calls and references may be left out. Definitions with errors in their syntax are left out; a file in which nothing else is left has no rows."""
    try:
        try:
            f = _File(path, content, wanted)
        except SyntaxError:
            whole = mended(content)
            if whole is None:
                return {}
            f = _File(path, whole, wanted)
            if not f.tree.body or all(isinstance(x, ast.Pass) for x in f.tree.body):
                return {}
    except (SyntaxError, ValueError, RecursionError):
        return {}
    for s in f.tree.body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            f.function(s, None)
        elif isinstance(s, ast.ClassDef):
            f.cls(s)
        elif isinstance(s, (ast.Assign, ast.AnnAssign)):
            f.variable(s, None)
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            f.imported(s)
    if wanted is None or "refs" in wanted:
        f.references()
    return {"symbols": f.symbols, "imports": f.imports, "exports": f.exports(), "calls": collapse(f.calls), "refs": f.refs, "type_rels": f.relations}


parse.prunes = True
