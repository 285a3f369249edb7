"""Symbols of brace languages: a scanner that blanks strings and comments, then matches braces."""

from __future__ import annotations

import re

_QUOTED = re.compile(r"""//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_DOC = re.compile(r"/\*\*(?!/).*?\*/", re.S)
#: Words that look like a call or a method but open a statement.
KEYWORDS = frozenset("if for while switch catch do else try return new throw synchronized function with super this await typeof case in of instanceof delete yield".split())

MODIFIERS = frozenset("public protected private static final abstract native synchronized default strictfp".split())


def blanked(code: str) -> str:
    """The code with the inside of strings and comments as blanks; offsets and line ends stay."""
    return _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def closing(code: str, at: int) -> int:
    """Offset past the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _after_parameters(code: str, at: int) -> int:
    """Offset past the parenthesis that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()]").finditer(code, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return len(code)


def _classes(plain: str, pattern: str) -> list[tuple[int, int, str]]:
    out = []
    for m in re.finditer(pattern, plain):
        opening = plain.find("{", m.end())
        if opening >= 0:
            out.append((opening, closing(plain, opening), m[1]))
    return out


def _owner(classes: list[tuple[int, int, str]], at: int) -> tuple[int, str] | None:
    """The innermost class around an offset, and where its body begins."""
    around = [c for c in classes if c[0] < at < c[1]]
    return (max(around)[0], max(around)[2]) if around else None


def _symbol(code: str, name: str, begin: int, end: int, owner: str | None, doc: str | None = None) -> dict:
    body = code[begin:end]
    out = {"name": name, "function_name": name, "code": body, "lineno": code.count("\n", 0, begin) + 1, "end_lineno": code.count("\n", 0, end) + 1, "class_name": owner}
    return out | ({"docstring": doc} if doc else {})


def _direct(plain: str, body: int, at: int) -> bool:
    """Whether an offset is directly in the body that opens at ``body``."""
    return plain.count("{", body, at) - plain.count("}", body, at) == 1


def java_symbols(content: bytes) -> list[dict]:
    """Methods with a body; constructors and bodiless ones are left out."""
    code = content.decode("utf-8", "replace")
    plain = blanked(code)
    classes = _classes(plain, r"\b(?:class|interface|enum|record)\s+(\w+)")
    head = re.compile(r"(?<![\w.@])(?:(?:@\w+(?:\([^)]*\))?|public|protected|private|static|final|abstract|native|synchronized|default|strictfp)\s+)*(?:<[^{};()]+>\s*)?(?P<type>[\w.]+)(?:<[^{};()]*>)?(?:\[\])*\s+(?P<name>\w+)\s*(?=\()")
    out = []
    for m in head.finditer(plain):
        owner = _owner(classes, m.start("name"))
        # A modifier where the type should be: a constructor.
        if m["name"] in KEYWORDS or m["type"] in KEYWORDS | MODIFIERS or owner is None or not _direct(plain, owner[0], m.start("name")):
            continue
        after = re.compile(r"\s*(?:throws\s+[\w.,\s]+)?\{").match(plain, _after_parameters(plain, m.end()))
        if after:
            out.append(_symbol(code, m["name"], m.start(), closing(plain, after.end() - 1), owner[1]))
    return out


def _docs(code: str) -> list[tuple[int, str]]:
    """(end, text) of documentation comments."""
    found = []
    for m in _DOC.finditer(code):
        inner = re.sub(r"(?m)^[ \t]*\*[ \t]?", "", m[0][3:-2])
        found.append((m.end(), inner.strip()))
    return found


def script_symbols(content: bytes) -> list[dict]:
    """Function declarations and methods, private ones included; arrows and function variables are not symbols."""
    code = content.decode("utf-8", "replace")
    plain, docs = blanked(code), _docs(code)
    classes = _classes(plain, r"\bclass\s+(\w+)")

    def doc(begin: int) -> str | None:
        """The nearest comment before, if only blanks and modifiers stand between."""
        near = [d for d in docs if d[0] <= begin]
        return near[-1][1] if near and re.fullmatch(r"(?:\s|export|default|async|public|private|protected|static|readonly|override|@\w+(?:\([^)]*\))?)*", plain[near[-1][0] : begin]) else None

    blank, operator = re.compile(r"\s*"), re.compile(r"\b(?:is|keyof|extends)\s*$")

    def body(at: int) -> int | None:
        """Where the body opens after the parameters; a brace where a type is due opens an object type."""
        at = blank.match(plain, at).end()
        if plain[at : at + 1] != ":":
            return at if plain[at : at + 1] == "{" else None
        due = True
        while at < len(plain):
            c = plain[at]
            if c == "{":
                if not due and not operator.search(plain, max(0, at - 9), at):
                    return at
                at, due = closing(plain, at), False
                continue
            if c in ";}" or (c == "=" and plain[at + 1 : at + 2] != ">"):
                return None
            arrow = c == "="
            due = due if c.isspace() else arrow or c in ":<|&,(["
            at += 2 if arrow else 1
        return None

    out = []
    for m in re.finditer(r"(?<![\w.$])(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^()]*>)?(?=\()", plain):
        before = plain[: m.start()].rstrip()
        if before.endswith(("=", "(", ",", ":", "?", "return", "=>")):
            continue
        if (opening := body(_after_parameters(plain, m.end()))) is not None:
            out.append((m.start(), _symbol(code, m[1], m.start(), closing(plain, opening), None, doc(m.start()))))
    head = re.compile(r"(?<![\w.#])((?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*)(#?\w+)\s*(?:<[^(){};]*>)?(?=\()")
    for m in head.finditer(plain):
        owner = _owner(classes, m.start(2))
        if m[2] in KEYWORDS or owner is None or not _direct(plain, owner[0], m.start(2)):
            continue
        if plain[: m.start()].rstrip()[-1:] not in ("{", "}", ";", ")", "") and "\n" not in plain[len(plain[: m.start()].rstrip()) : m.start(2)]:
            continue
        if (opening := body(_after_parameters(plain, m.end()))) is not None:
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((begin, _symbol(code, m[2], begin, closing(plain, opening), owner[1], doc(begin))))
    return [s for _, s in sorted(out, key=lambda x: x[0])]
