"""Source files as parsed code: which parser a file has, Python modules, Markdown pages."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import markdown_paragraph, markdown_title, or_else

# The language of a file by its extension, and the verbs of route decorators.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript",
    "java": "java", "go": "go", "sql": "sql", "md": "markdown", "markdown": "markdown",
}
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
#: Folders that hold sources and are no part of a module's name.
ROOTS = ("src", "lib", "app")

_PARTS = """doc string, classes array<struct<name:string,bases:array<string>,doc:string,entity:boolean,refs:array<string>,views:array<string>>>,
functions array<string>, imports array<string>, routes array<struct<label:string,handler:string>>, constants array<string>, error string"""


def language_of(path: Column) -> Column:
    """The language of a file by its extension in any case; null for other files."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return known[F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))]


def module_name(path: Column) -> Column:
    """The dotted name of a Python file, without the folder of sources that it may stand in."""
    below = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^(?:{'|'.join(ROOTS)})/", "")
    return F.btrim(F.replace(F.regexp_replace(below, r"(?:/__init__)?\.py$", ""), F.lit("/"), F.lit(".")), F.lit("."))


def _route(owner: str, function) -> list[dict]:
    """``VERB path: name``, and the handler with its class, of the first decorator of a function that is a call of a verb."""
    for d in function.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr.lower() in VERBS:
            given = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else None
            return [{"label": f"{d.func.attr.upper()} {given if isinstance(given, str) else ''}: {function.name}", "handler": owner + function.name}]
    return []


def _parsed(source: str | None) -> dict:
    none = {"classes": [], "functions": [], "imports": [], "routes": [], "constants": []}
    try:
        tree = ast.parse(source or "")
        classes = [n for n in tree.body if isinstance(n, ast.ClassDef)]
        held = [("", n) for n in tree.body] + [(c.name + ".", n) for c in classes for n in c.body]
        functions = [(owner, n) for owner, n in held if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        imports = [[a.name for a in n.names] if isinstance(n, ast.Import) else [n.module] for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
        names = [t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        return none | {
            "doc": ast.get_docstring(tree),
            "classes": [{"name": c.name, "bases": [ast.unparse(b) for b in c.bases], "doc": ast.get_docstring(c), "entity": False, "refs": [], "views": []} for c in classes],
            "functions": [owner + n.name for owner, n in functions],
            "imports": list(dict.fromkeys(name for group in imports for name in group if name)),
            "routes": [r for owner, n in functions for r in _route(owner, n)],
            "constants": [n for n in names if n.isascii() and n[0].isalpha() and n.isupper()],
        }
    except (SyntaxError, ValueError, RecursionError, MemoryError) as broken:
        return none | {"error": type(broken).__name__}


def python_modules(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, module_name, doc, classes, functions, imports, routes, constants, error) of Python files; other files have no row.

    Classes and functions are those of the module's first level and the methods
    of its classes; imports without a module (``from . import x``) are left out.
    A file that is no Python has empty lists and the ``error``; a null text is
    an empty module.
    """
    parse = F.udf(_parsed, _PARTS, useArrow=True)
    rows = files.where(language_of(F.col(path)) == "python").select(path, module_name(F.col(path)).alias("module_name"), parse(text).alias("p"))
    return rows.select(path, "module_name", "p.*")


def markdown_pages(files: DataFrame, path: str = "path", text: str = "text", most: int = 1000) -> DataFrame:
    """(path, title, summary) of Markdown files: the first heading, else the path, and the first paragraph."""
    rows = files.where(language_of(F.col(path)) == "markdown")
    body = F.coalesce(F.col(text), F.lit(""))
    return rows.select(path, or_else(markdown_title(body), F.col(path)).alias("title"), F.coalesce(F.left(markdown_paragraph(body), F.lit(most)), F.lit("")).alias("summary"))
