"""Source files and the functions in them. Python's own parser runs in a table function, once a file."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATION = "kind:string,expression:string,line:int,relative_line:int"
UNIT = f"ord int, name string, qualname string, source string, start_line int, end_line int, parameters array<string>, type_hints map<string,string>, operations array<struct<{OPERATION}>>, loops array<string>, conditionals array<string>, guards array<string>, branch_count int, exec_exprs array<string>, assert_tests array<string>, is_async boolean, risks array<string>, has_if boolean, assert_after_exit boolean"
FILE_FACTS = "ok boolean, imports array<string>, top_level_calls int, top_level_ifs int, first_function string"


def read_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of all .py files, folders searched in depth, __pycache__ left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(list(paths), wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.col("value").alias("text")).where(~F.contains(path, F.lit("/__pycache__/")))


#: Node kinds that a unit reports as operations, and those that count as executable expressions.
_OPERATIONS = {ast.Subscript: "subscript", ast.Call: "call", ast.BinOp: "division"}
_DIVIDES = (ast.Div, ast.FloorDiv, ast.Mod)
_EXECUTABLE = (ast.Call, ast.Subscript, ast.BinOp, ast.Compare, ast.Attribute)


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def _operation_kind(node: ast.AST) -> str | None:
    kind = _OPERATIONS.get(type(node))
    return None if kind == "division" and not isinstance(node.op, _DIVIDES) else kind


def _read_parts(node: ast.AST) -> list[ast.AST]:
    """The children that a body is searched in: a nested function's body, an annotated assignment's value."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return node.body
    if isinstance(node, ast.AnnAssign):
        return [node.value] if node.value is not None else []
    return list(ast.iter_child_nodes(node))


def _body_facts(f: ast.AST, text: str) -> dict[str, list]:
    """What one function's body holds in page order, nested functions included: one walk with a stack."""
    out: dict[str, list] = {"operations": [], "loops": [], "conditionals": [], "guards": []}
    todo = _read_parts(f)[::-1]
    while todo:
        node = todo.pop()
        if kind := _operation_kind(node):
            out["operations"].append((kind, ast.unparse(node), node.lineno, node.lineno - f.lineno + 1))
        if isinstance(node, (ast.For, ast.While)):
            out["loops"].append(ast.get_source_segment(text, node) or ast.unparse(node))
        if isinstance(node, (ast.If, ast.Assert)):
            test = ast.unparse(node.test)
            out["guards"].append(test)
            if isinstance(node, ast.If):
                out["conditionals"].append(test)
        todo += _read_parts(node)[::-1]
    return out


def _standalone_facts(source: str) -> tuple[list[str], list[str]]:
    """(executable expressions, assert tests) of a unit's own source; none if that does not parse alone, as an indented method."""
    tree = _parsed(source)
    nodes = list(ast.walk(tree)) if tree else []
    return sorted({ast.unparse(n) for n in nodes if isinstance(n, _EXECUTABLE)}), [ast.unparse(n.test) for n in nodes if isinstance(n, ast.Assert)]


def _assert_after_exit(f: ast.AST) -> bool:
    """Whether, level by level, some assert comes after an if that returns."""
    left = False
    for node in ast.walk(f):
        left = left or (isinstance(node, ast.If) and any(isinstance(x, ast.Return) for x in ast.walk(node)))
        if left and isinstance(node, ast.Assert):
            return True
    return False


def units_of(text: str) -> Iterator[tuple]:
    """A row for each function, methods and nested ones too; none if the text is not Python."""
    tree = _parsed(text)
    if tree is None:
        return
    lines = text.splitlines()
    found = []

    def walk(node: ast.AST, scope: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if child.name.startswith("test_") or (child.name == "main" and not scope):
                    continue
                found.append((child, ".".join((*scope, child.name))))
                walk(child, (*scope, child.name))
            elif isinstance(child, ast.ClassDef):
                walk(child, (*scope, child.name))
            else:
                walk(child, scope)

    walk(tree, ())
    for i, (f, qualname) in enumerate(found):
        body, source = _body_facts(f, text), "\n".join(lines[f.lineno - 1 : f.end_lineno])
        hints = {a.arg: ast.unparse(a.annotation) for a in f.args.args if a.annotation is not None}
        if f.returns is not None:
            hints["return"] = ast.unparse(f.returns)
        exprs, asserts = _standalone_facts(source)
        risks = sorted({k for k in map(_operation_kind, ast.walk(f)) if k} | {"assert" for x in ast.walk(f) if isinstance(x, ast.Assert)})
        ifs = any(isinstance(x, ast.If) for x in ast.walk(f))
        yield i, f.name, qualname, source, f.lineno, f.end_lineno, [a.arg for a in f.args.args], hints, body["operations"], body["loops"], body["conditionals"], body["guards"], len(body["conditionals"]), exprs, asserts, isinstance(f, ast.AsyncFunctionDef), risks, ifs, _assert_after_exit(f)


def facts_of(text: str) -> tuple:
    """(parses, imported packages, top-level calls, top-level ifs, first function that is not a test)."""
    tree = _parsed(text)
    if tree is None:
        return False, [], 0, 0, None
    imports = {n.name.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.Import) for n in x.names}
    imports |= {x.module.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.ImportFrom) and x.module}
    calls = sum(isinstance(x, ast.Expr) and isinstance(x.value, ast.Call) for x in tree.body)
    names = [x.name for x in ast.walk(tree) if isinstance(x, ast.FunctionDef) and not x.name.startswith("test_")]
    return True, sorted(imports), calls, sum(isinstance(x, ast.If) for x in tree.body), names[0] if names else None


def extract_units(sources: DataFrame) -> DataFrame:
    """(path, text) to one row for each function, with its metrics."""
    names = [x.split()[0] for x in UNIT.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b["text"].to_pylist()
            known = {t: list(units_of(t or "")) for t in set(texts)}  # copies are parsed once a batch
            out = [(p, *u) for p, t in zip(b["path"].to_pylist(), texts) for u in known[t]]
            cols = list(zip(*out)) if out else [[] for _ in range(len(names) + 1)]
            rows = [dict(zip(("path", *names), r)) for r in zip(*cols)]
            for r in rows:
                r["operations"] = [dict(zip(("kind", "expression", "line", "relative_line"), o)) for o in r["operations"]]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())

    out = sources.select("path", "text").mapInArrow(run, f"path string, {UNIT}")
    return out.withColumns({"line_count": F.col("end_line") - F.col("start_line") + 1, "parameter_count": F.size("parameters"), "loop_count": F.size("loops"), "operation_count": F.size("operations")})


def _arrow_schema():
    import pyarrow as pa

    texts, op = pa.list_(pa.string()), pa.struct([("kind", pa.string()), ("expression", pa.string()), ("line", pa.int32()), ("relative_line", pa.int32())])
    return pa.schema([("path", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("qualname", pa.string()), ("source", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parameters", texts), ("type_hints", pa.map_(pa.string(), pa.string())), ("operations", pa.list_(op)), ("loops", texts), ("conditionals", texts), ("guards", texts), ("branch_count", pa.int32()), ("exec_exprs", texts), ("assert_tests", texts), ("is_async", pa.bool_()), ("risks", texts), ("has_if", pa.bool_()), ("assert_after_exit", pa.bool_())])


def file_facts(sources: DataFrame) -> DataFrame:
    """(path, text) to facts of each file, for lint rules."""

    @F.udf(f"struct<{FILE_FACTS.replace(' ', ':').replace(',:', ',')}>", useArrow=True)
    def facts(text):
        return facts_of(text or "")

    return sources.select("path", facts("text").alias("f")).select("path", "f.*")


def _expression(text: str | None) -> ast.expr | None:
    try:
        return ast.parse(text, mode="eval").body if text else None
    except (SyntaxError, ValueError):
        return None


def normal_expression(text: str | None) -> str | None:
    """Canonical form of an expression; None if it is blank or is none (an assert statement is none)."""
    node = _expression(text)
    return None if node is None else ast.unparse(node)


def normal_assertion(text: str | None) -> str | None:
    """Canonical form of the test of `assert test`, or of a bare expression; None for anything else."""
    tree = _parsed((text or "").strip())
    if tree is None or len(tree.body) != 1:
        return None
    only = tree.body[0]
    return ast.unparse(only.test) if isinstance(only, ast.Assert) else ast.unparse(only.value) if isinstance(only, ast.Expr) else None


def constant_divisor(text: str | None) -> bool:
    """Whether the whole expression is a division by a literal other than zero; a signed number is no literal."""
    top = _expression(text)
    return isinstance(top, ast.BinOp) and isinstance(top.op, _DIVIDES) and isinstance(top.right, ast.Constant) and top.right.value != 0


def expression_facts(expression: Column) -> Column:
    """struct(normal, assertion, constant_divisor) of reported expressions, by Python's parser; equal ones of a batch are parsed once."""

    @F.pandas_udf("normal string, assertion string, constant_divisor boolean")
    def facts(text: pd.Series) -> pd.DataFrame:
        known = {t: (normal_expression(t), normal_assertion(t), constant_divisor(t)) for t in text.unique()}
        return pd.DataFrame([known[t] for t in text], columns=["normal", "assertion", "constant_divisor"])

    return facts(expression)
