"""Python symbols from the standard syntax tree, with an indentation scanner for broken files."""

from __future__ import annotations

import ast
import re

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Statements that open a top-level block, and route decorator methods.
BLOCK_STATEMENTS = (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Expr, ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)
ROUTE_METHODS = frozenset("get post put patch delete options head api_route route".split())
#: Labels of the metadata lines in embedding text, in order.
LABELS = {"params": "Parameters", "returns": "Returns", "decorators": "Decorators", "framework_tags": "Framework tags", "routes": "Routes", "imports": "Imports", "calls": "Calls", "assigned_names": "Assigned names"}


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; what isn't a name is left out."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


class Facts(ast.NodeVisitor):
    """Calls, stored names and imports anywhere below a node, nested functions included."""

    def __init__(self, *nodes: ast.AST):
        self.calls, self.stored, self.imports = set(), set(), set()
        for node in nodes:
            self.visit(node)

    def visit_Call(self, node):
        self.calls.add(dotted(node.func))
        self.generic_visit(node)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Store):
            self.stored.add(node.id)

    def visit_Import(self, node):
        self.imports.update(a.name for a in node.names)

    def visit_ImportFrom(self, node):
        self.imports.update(".".join(filter(None, (node.module, a.name))) for a in node.names)

    def lists(self) -> dict:
        return {"calls": sorted(self.calls - {""}), "assigned_names": sorted(self.stored)}


def parameters(args: ast.arguments) -> list[str]:
    """name: annotation, positional ones first, then keyword-only, then the starred."""
    order = args.posonlyargs + args.args + args.kwonlyargs + [a for a in (args.vararg, args.kwarg) if a]
    return [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in order]


def routes(decorators: list[ast.expr]) -> list[dict]:
    out = []
    for d in decorators:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_METHODS:
            first = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else None
            out.append({"framework": "fastapi", "method": d.func.attr.upper(), "path": first if isinstance(first, str) else None})
    return out


def tags(name: str, decorators: list[ast.expr], found_routes: list) -> list[str]:
    names = [dotted(d.func if isinstance(d, ast.Call) else d) for d in decorators]
    is_test = name.startswith("test_") or {"fixture", "pytest.fixture"} & set(names)
    django = any("django" in ast.unparse(d).lower() for d in decorators)
    return sorted(t for t, on in (("fastapi_route", found_routes), ("pytest", is_test), ("django", django)) if on)


def embedding_text(code: str, static: dict) -> str:
    """The code with a labelled line for each kind of metadata that there is."""
    lines = [code] + ([f"\nDocstring: {static['docstring']}"] if static.get("docstring") else [])
    for key, label in LABELS.items():
        if value := static.get(key):
            lines.append(f"{label}: {', '.join(map(str, value)) if isinstance(value, list) else value}")
    return "\n".join(lines)


def _symbol(name: str, kind: str, raw: str, begin: int, end: int, static: dict, owner: str | None = None) -> dict:
    return {"name": name, "function_name": name, "code": embedding_text(raw, static), "raw_code": raw, "lineno": begin, "end_lineno": end, "class_name": owner, "symbol_kind": kind, "docstring": static.get("docstring"), "python_static": static}


def _function(node, lines: list[str], owner: str | None) -> dict:
    found = routes(node.decorator_list)
    static = {
        "docstring": ast.get_docstring(node), "params": parameters(node.args), "returns": ast.unparse(node.returns) if node.returns else None,
        "decorators": [ast.unparse(d) for d in node.decorator_list], "is_async": isinstance(node, ast.AsyncFunctionDef), "routes": found,
        "framework_tags": tags(node.name, node.decorator_list, found), **Facts(node).lists(),
    }
    return _symbol(node.name, "method" if owner else "function", "".join(lines[node.lineno - 1 : node.end_lineno]).rstrip("\n"), node.lineno, node.end_lineno, static, owner)


def _block(nodes: list[ast.stmt], lines: list[str]) -> dict:
    begin, end = nodes[0].lineno, max(n.end_lineno for n in nodes)
    facts, kinds = Facts(*nodes), [type(n).__name__ for n in nodes]
    static = {"block_type": "+".join(dict.fromkeys(kinds)), "block_types": kinds, "imports": sorted(facts.imports), "statement_count": len(nodes), **facts.lists()}
    name = f"CodeBlock:{begin}-{end}" + (f":calls={','.join(static['calls'][:3])}" if static["calls"] else "")
    return _symbol(name, "code_block", "".join(lines[begin - 1 : end]).strip("\n"), begin, end, static)


def _blocks(body: list[ast.stmt]) -> list[list[ast.stmt]]:
    """Runs of top-level statements; imports and bare strings go along with an open run only."""
    runs: list[list[ast.stmt]] = [[]]
    for node in body:
        bare = isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
        if bare or isinstance(node, (ast.Import, ast.ImportFrom)):
            if runs[-1]:
                runs[-1].append(node)
        elif isinstance(node, BLOCK_STATEMENTS):
            runs[-1].append(node)
        else:
            runs.append([])
    return [r for r in runs if r]


def _aliases(body: list[ast.stmt]) -> dict[str, str]:
    """Local name -> imported module or member, of module-level imports."""
    out = {}
    for node in body:
        if isinstance(node, ast.Import):
            out |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            out |= {a.asname or a.name: ".".join(filter(None, (node.module, a.name))) for a in node.names}
    return out


def python_symbols(content: bytes) -> list[dict]:
    text = content.decode("utf-8", "replace")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return broken_symbols(text)
    lines, found = text.splitlines(keepends=True), []
    for node in tree.body:
        if isinstance(node, DEFS):
            found.append(_function(node, lines, None))
        elif isinstance(node, ast.ClassDef):
            found += [_function(n, lines, node.name) for n in node.body if isinstance(n, DEFS)]
    found += [_block(run, lines) for run in _blocks(tree.body)]
    local = {s["name"] for s in found if s["symbol_kind"] != "code_block"}
    modules = _aliases(tree.body)
    for s in found:
        static = s["python_static"]
        static["local_calls"] = [c for c in static["calls"] if c.rsplit(".", 1)[-1] in local]
        heads = ((c, c.split(".")[0]) for c in static["calls"])
        static["external_import_calls"] = [".".join([modules[h], *c.split(".")[1:]]) for c, h in heads if h in modules]
    return sorted(found, key=lambda s: (s["lineno"], s["symbol_kind"] == "code_block"))


_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def broken_symbols(text: str) -> list[dict]:
    """Functions of a file that doesn't parse, by indentation; nested ones are included."""
    lines, open_classes, out = text.splitlines(keepends=True), [], []
    for k, line in enumerate(lines):
        if not (m := _HEAD.match(line)):
            continue
        depth = len(m[1].expandtabs(8))
        open_classes = [c for c in open_classes if c[0] < depth]
        if m[2] == "class":
            open_classes.append((depth, m[3]))
            continue
        end = k + 1
        for j in range(k + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j].expandtabs(8)) - len(lines[j].expandtabs(8).lstrip()) <= depth:
                    break
                end = j + 1
        owner = open_classes[-1][1] if open_classes else None
        out.append(_symbol(m[3], "method" if owner else "function", "".join(lines[k:end]).rstrip("\n"), k + 1, end, {"fallback": "tree_sitter"}, owner))
    return out
