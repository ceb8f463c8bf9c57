"""Break points of source code: where declarations begin, for chunks that do not cut functions in two."""

from __future__ import annotations

import ast
import re

# Languages by extension, and what a break before a declaration is worth.
LANGUAGES = {"py": "python", "ts": "brace", "tsx": "brace", "js": "brace", "jsx": "brace", "mts": "brace", "cts": "brace", "mjs": "brace", "cjs": "brace", "go": "brace", "rs": "brace"}
WORTH = {"class": 100, "interface": 100, "struct": 100, "trait": 100, "impl": 100, "mod": 100, "export": 90, "function": 90, "func": 90, "fn": 90, "method": 90, "decorated": 90, "type": 80, "enum": 80, "import": 60, "use": 60}
#: Words that may stand before a declaration's own.
BEFORE = r"(?:pub(?:\([^)]*\))?|async|default|abstract|declare|unsafe|static|public|private|protected|readonly|extern)"
DECLARED = re.compile(rf"[ \t]*(?P<export>export\b)?[ \t]*(?:{BEFORE}[ \t]+)*(?P<kind>class|interface|struct|trait|impl|mod|function|func|fn|type|enum|import|use)\b")
ARROW = re.compile(r"[ \t]*(?P<export>export[ \t]+)?(?:const|let|var)[ \t]+\w+[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b|(?:\([^)\n]*\)|\w+)[^=\n]*=>)")
METHOD = re.compile(rf"[ \t]+(?:{BEFORE}[ \t]+|get[ \t]+|set[ \t]+|\*)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[A-Za-z_$#]\w*[ \t]*(?:<[^>\n]*>)?\([^;{{}}]*\)[^;{{}}\n]*\{{")
#: Strings and comments, in which braces do not count. A string ends with its line at the latest, but for backquoted ones.
QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`?", re.S)


def language(path: str | None) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def code_breaks(text: str, path: str | None) -> dict[int, int]:
    """Positions of declarations and what a break there is worth; none for other files and for code that cannot be read."""
    kind = language(path)
    return {} if kind is None else _python(text) if kind == "python" else _braces(text)


def _python(text: str) -> dict[int, int]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return {}
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
    out: dict[int, int] = {}
    for node in ast.walk(tree):
        decorated = getattr(node, "decorator_list", [])
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            worth = WORTH["class"] if isinstance(node, ast.ClassDef) else WORTH["function"]
            line = min([node.lineno, *(d.lineno for d in decorated)])
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            worth, line = WORTH["import"], node.lineno
        else:
            continue
        at = starts[line - 1]
        out[at] = max(out.get(at, 0), worth)
    return out


def _braces(text: str) -> dict[int, int]:
    """Lines outside strings and comments that begin a declaration, at any depth; methods where a class is open."""
    plain = QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: dict[int, int] = {}
    depth, classes = 0, []  # depths at which classes and the like are open
    for m in re.finditer(r"[^\n]*\n?", plain):
        line = m[0]
        if not line:
            break
        d, worth = DECLARED.match(line), 0
        if d:
            worth = max(WORTH[d["kind"]], WORTH["export"] if d["export"] else 0)
        elif a := ARROW.match(line):
            worth = WORTH["export"] if a["export"] else WORTH["function"]
        elif classes and depth == classes[-1] + 1 and METHOD.match(plain, m.start()):
            worth = WORTH["method"]
        if worth:
            out[m.start()] = worth
            if d and d["kind"] in ("class", "interface", "trait", "impl"):
                classes.append(depth)
        depth += line.count("{") - line.count("}")
        while classes and depth <= classes[-1] and "}" in line:
            classes.pop()
    return out
