"""Facts about Python source texts that only a Python parser can give.

The one Arrow UDF of the package: texts are parsed with the standard library, never run.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

# Fixed value: names that count as known without a definition.
KNOWN_NAMES = ["print", "len", "str", "int", "float", "list", "dict", "range", "enumerate"]
UNDEFINED_LIMIT = 5

FACTS = StructType(
    [
        StructField("parses", BooleanType()),
        StructField("compiles", BooleanType()),
        StructField("functions", LongType()),
        StructField("classes", LongType()),
        StructField("imports", LongType()),
        StructField("comprehensions", LongType()),
        StructField("undefined", ArrayType(StringType())),
    ]
)


def _facts(source: str) -> dict:
    out = {"parses": False, "compiles": False, "functions": 0, "classes": 0, "imports": 0, "comprehensions": 0, "undefined": []}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(source)
            out["parses"] = True
            compile(source, "<text>", "exec", dont_inherit=True)
            out["compiles"] = True
        except Exception:
            if not out["parses"]:
                return out
    counted = {ast.FunctionDef: "functions", ast.ClassDef: "classes", ast.Import: "imports", ast.ListComp: "comprehensions"}
    stored, missing, todo = set(KNOWN_NAMES), [], [tree]
    while todo:
        node = todo.pop()
        if type(node) in counted:
            out[counted[type(node)]] += 1
        elif isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                stored.add(node.id)
            elif isinstance(node.ctx, ast.Load) and node.id not in stored and not node.id.startswith("_"):
                missing.append(node.id)
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    # The limit is on uses, before repeated names are folded.
    out["undefined"] = sorted(set(missing[:UNDEFINED_LIMIT]))
    return out


@F.pandas_udf(FACTS)
def python_facts(source: pd.Series) -> pd.DataFrame:
    """Facts per text; a NULL text (another language) costs nothing."""
    blank = dict.fromkeys(FACTS.names)
    frame = pd.DataFrame([blank if text is None else _facts(text) for text in source], columns=list(blank))
    counts = ["functions", "classes", "imports", "comprehensions"]
    return frame.astype({name: "Int64" for name in counts})
