"""Feature programs: a subset of Python text about a frame, compiled to columns and never executed.

A program is a function of one frame whose statements assign columns. Its expressions become either columns of
the same row, or statistics of the frame that are computed by distributed aggregations and joined back:

* a statistic of a whole column is one row, broadcast;
* a statistic of a group, a frequency or a rank is one row a value, joined by value.

Null, NaN and infinities are null, and so is a division by zero; see ``functions.numeric``.
"""

from __future__ import annotations

import ast
import itertools
import math
import re
import textwrap
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featherloom.functions import numeric as N
from featherloom.operators.order import grouped_quantile, grouped_quantiles, running_total, value_ranks


class UnsupportedProgram(ValueError):
    """The text isn't in the language; the message says what isn't."""


VERSIONED = re.compile(r"_v\d+$")
#: Functions of one column, by their names in programs.
UNARY = {
    "abs": F.abs, "absolute": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "square": lambda x: x * x,
    "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "tanh": F.tanh, "sin": F.sin, "cos": F.cos, "expit": N.sigmoid, "sigmoid": N.sigmoid,
}
REDUCERS = {"sum": N.row_sum, "mean": N.row_mean, "max": N.row_max, "min": N.row_min, "std": N.row_std, "var": N.row_var, "prod": N.row_product, "median": N.row_median, "skew": N.row_skew, "kurt": N.row_kurtosis, "kurtosis": N.row_kurtosis}
#: Functions of a row's values that count the population, not a sample.
POPULATION = {"entropy": N.row_entropy, "skew": lambda cs: N.row_skew(cs, sample=False), "kurtosis": lambda cs: N.row_kurtosis(cs, sample=False)}
OPERATORS = {"add": ast.Add, "sub": ast.Sub, "subtract": ast.Sub, "mul": ast.Mult, "multiply": ast.Mult, "div": ast.Div, "divide": ast.Div, "truediv": ast.Div, "true_divide": ast.Div, "mod": ast.Mod, "pow": ast.Pow, "power": ast.Pow, "floordiv": ast.FloorDiv, "floor_divide": ast.FloorDiv}
COMPARISONS = {"gt": ast.Gt, "ge": ast.GtE, "lt": ast.Lt, "le": ast.LtE, "eq": ast.Eq, "ne": ast.NotEq, "greater": ast.Gt, "less": ast.Lt, "equal": ast.Eq}
SCALERS = {"StandardScaler": "standard", "MinMaxScaler": "minmax", "RobustScaler": "robust", "scale": "standard", "minmax_scale": "minmax", "robust_scale": "robust"}
#: A program may unroll to so many statements.
STATEMENTS = 2_000


def _sample_skew(c) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _sample_kurtosis(c) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


#: Statistics of a column or group.
STATISTICS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "nunique": F.count_distinct, "skew": _sample_skew, "kurt": _sample_kurtosis, "kurtosis": _sample_kurtosis}


@dataclass(frozen=True)
class Value:
    """A column of the frame so far; text columns keep their type. ``group`` is the key of the group whose rows a function sees."""

    col: Column
    text: bool = False
    group: Value | None = None


class Columns(list):
    """The values of some columns, with their names; ``row`` if they stand for one row that a function sees."""

    def __init__(self, values: list[Value], names: list[str], row: bool = False):
        super().__init__(values)
        self.names, self.row = names, row


@dataclass(frozen=True)
class Counts:
    """How often each value of a column comes, as a table to look up in."""

    value: Value
    share: bool


@dataclass(frozen=True)
class GroupTable:
    """A statistic of each group, as a table to look up in."""

    key: Value
    value: Value
    how: str


@dataclass(frozen=True)
class Scaling:
    kind: str


@dataclass
class Frame:
    """The frame while a program is applied."""

    df: DataFrame
    columns: list[str]
    made: list[str] = field(default_factory=list)
    count: int = 0

    def add(self, name: str, c: Column, dry: bool) -> None:
        if not dry:
            self.df = self.df.withColumn(name, c)
        if name not in self.columns:
            self.columns.append(name)

    def fresh(self) -> str:
        self.count += 1
        return f"_p{self.count}"


def function_of(source: str) -> ast.FunctionDef:
    """The function of a saved program: modify_features if there is one, else the last by name that begins so."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        raise UnsupportedProgram(f"syntax: {e.__class__.__name__}") from None
    found = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef)}
    names = sorted(n for n in found if n.startswith("modify_features"))
    if not names:
        raise UnsupportedProgram("no function modify_features")
    return found.get("modify_features") or found[names[-1]]


def calls_ancestor(source: str) -> bool:
    """Whether the program names an earlier version of itself, as in modify_features_v0."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return bool(re.search(r"\w_v\d+\s*\(", source))
    names = (n.name if isinstance(n, ast.FunctionDef) else n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else "" for n in ast.walk(tree))
    return any(VERSIONED.search(n) for n in names)


class _Compiler:
    def __init__(self, fn: ast.FunctionDef, df: DataFrame, dry: bool = False):
        self.fn, self.dry = fn, dry
        types = {f.name: f.dataType for f in df.schema}
        self.types = types
        self.frame = Frame(df, list(types))
        self.texts = {c for c, t in types.items() if isinstance(t, T.StringType)}
        self.numbers = [c for c, t in types.items() if isinstance(t, (T.NumericType, T.BooleanType))]
        floats = [c for c in self.numbers if isinstance(types[c], (T.DoubleType, T.FloatType))]
        self.frame.df = df.withColumns({c: N.finite(F.col(f"`{c}`")) for c in floats}) if floats and not dry else df
        self.frames = {a.arg for a in fn.args.args[:1]}
        self.locals: dict[str, object] = {}
        self.left = STATEMENTS

    # -- columns -----------------------------------------------------------------
    def column(self, name: str) -> Value:
        if name not in self.frame.columns:
            raise UnsupportedProgram(f"column {name}")
        c = F.col(f"`{name}`")
        return Value(c, True) if name in self.texts else Value(c.cast("double"))

    def held(self, value: Value) -> str:
        """The name of a helper column with the value, for an aggregation."""
        name = self.frame.fresh()
        self.frame.df = self.frame.df.withColumn(name, value.col)
        return name  # not one of the program's columns

    def assign(self, name: str, value: object) -> None:
        if any(c != name and c.lower() == name.lower() for c in self.frame.columns):
            raise UnsupportedProgram(f"column {name} differs from another by case alone")
        v = self.value(value)
        self.frame.add(name, v.col if v.text else N.finite(v.col), self.dry)
        (self.texts.add if v.text else self.texts.discard)(name)
        if not v.text and name not in self.numbers:
            self.numbers.append(name)
        if name not in self.frame.made:
            self.frame.made.append(name)

    @staticmethod
    def value(x: object) -> Value:
        if isinstance(x, Value):
            return x
        if isinstance(x, bool):
            return Value(F.lit(int(x)).cast("double"))
        if isinstance(x, (int, float)):
            return Value(F.lit(float(x)))
        if isinstance(x, str):
            return Value(F.lit(x), True)
        if x is None:
            return Value(F.lit(None).cast("double"))
        if isinstance(x, list) and len(x) == 1 and isinstance(x[0], Value):
            return x[0]
        raise UnsupportedProgram(f"value of type {type(x).__name__}")

    def number(self, x: object) -> Column:
        v = self.value(x)
        return v.col.try_cast("double") if v.text else v.col.cast("double")

    # -- statistics of the frame --------------------------------------------------
    def statistic(self, value: Value, name: str) -> Value:
        if value.group is not None:
            return self.of_group(value.group, value, name)
        if name == "median":
            return self.quantiles(value, 0.5)[0]
        return self.statistics(value, STATISTICS[name])[0]

    def statistics(self, value: Value, *aggregates) -> list[Value]:
        """Statistics of a whole column in one aggregation: one row, broadcast."""
        if self.dry:
            return [Value(F.lit(None).cast("double"))] * len(aggregates)
        held, names = self.held(Value(self.number(value)) if not value.text else value), [self.frame.fresh() for _ in aggregates]
        one = self.frame.df.agg(*[f(held).cast("double").alias(n) for f, n in zip(aggregates, names)])
        self.frame.df = self.frame.df.crossJoin(F.broadcast(one))  # one row
        return [Value(F.col(n)) for n in names]

    def quantiles(self, value: Value, *qs: float) -> list[Value]:
        if not all(isinstance(q, (int, float)) and 0 <= q <= 1 for q in qs):
            raise UnsupportedProgram("quantile")
        if self.dry:
            return [Value(F.lit(None).cast("double"))] * len(qs)
        held, names = self.held(Value(self.number(value))), [self.frame.fresh() for _ in qs]
        one = grouped_quantiles(self.frame.df, F.lit(0), F.col(held), dict(zip(names, qs))).agg(*[F.max(n).alias(n) for n in names])  # a row also of an empty column
        self.frame.df = self.frame.df.crossJoin(F.broadcast(one))  # one row
        return [Value(F.col(n)) for n in names]

    def scaled(self, kind: str, value: Value) -> Value:
        """(x - center) / width of the frame's column; a width of 0 counts as 1."""
        if kind == "robust":
            low, center, high = self.quantiles(value, 0.25, 0.5, 0.75)
            width = high.col - low.col
        else:
            center, other = self.statistics(value, *((F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)))
            width = other.col if kind == "standard" else other.col - center.col
        return Value(N.finite(N.divide(self.number(value) - center.col, F.when(width == 0, 1.0).otherwise(width))))

    def of_group(self, key: Value, value: Value, name: str, looked_up: Value | None = None) -> Value:
        """The statistic of each row's group; with looked_up, of the group whose key that value is."""
        if name not in (*STATISTICS, "median", "rank"):
            raise UnsupportedProgram(f"groups' {name}")
        if self.dry:
            return Value(F.lit(None).cast("double"))
        k, v, out = self.held(key), self.held(value), self.frame.fresh()
        if name in ("rank",):
            ranks = self.frame.df.filter(F.col(k).isNotNull() & F.col(v).isNotNull()).groupBy(F.col(k).alias(f"{out}k"), F.col(v).alias(f"{out}v")).agg(F.count("*").alias(f"{out}n"))
            placed = running_total(ranks, [f"{out}k", f"{out}v"], f"{out}n", f"{out}b")
            first = placed.groupBy(F.col(f"{out}k").alias(f"{out}f")).agg(F.min(f"{out}b").alias(f"{out}m"))
            ranked = placed.join(first, F.col(f"{out}k") == F.col(f"{out}f")).select(f"{out}k", f"{out}v", (F.col(f"{out}b") - F.col(f"{out}m") + (F.col(f"{out}n") + 1) / 2).alias(out))
            self.frame.df = self.frame.df.join(ranked, (F.col(k) == F.col(f"{out}k")) & (F.col(v) == F.col(f"{out}v")), "left").drop(f"{out}k", f"{out}v")
            return Value(F.col(out))
        if name == "median":
            table = grouped_quantile(self.frame.df, F.col(k), F.col(v), 0.5, out).withColumnRenamed("key", f"{out}k")
        else:
            # nothing but one row a group and task is shuffled
            table = self.frame.df.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"{out}k")).agg(STATISTICS[name](v).cast("double").alias(out))
        by = self.held(looked_up) if looked_up is not None else k
        self.frame.df = self.frame.df.join(table, F.col(by) == F.col(f"{out}k"), "left").drop(f"{out}k")
        return Value(F.col(out))

    def frequency(self, value: Value, share: bool, looked_up: Value | None = None) -> Value:
        if self.dry:
            return Value(F.lit(None).cast("double"))
        k, out = self.held(value), self.frame.fresh()
        table = self.frame.df.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"{out}k")).agg(F.count("*").cast("double").alias(out))
        if share:
            total = self.frame.df.agg(F.count(k).cast("double").alias(f"{out}t"))
            table = table.crossJoin(F.broadcast(total)).select(f"{out}k", (F.col(out) / F.col(f"{out}t")).alias(out))
        by = self.held(looked_up) if looked_up is not None else k
        self.frame.df = self.frame.df.join(table, F.col(by) == F.col(f"{out}k"), "left").drop(f"{out}k")
        return Value(F.col(out))

    def rank(self, value: Value, share: bool, how: str = "average", ascending: bool = True) -> Value:
        if how not in ("average", "min", "max", "dense"):
            raise UnsupportedProgram(f"rank by {how}: it would depend on the order of rows")
        if self.dry:
            return Value(F.lit(None).cast("double"))
        k, out = self.held(value if ascending else Value(-self.number(value))), self.frame.fresh()
        n = F.col("n")
        if how == "dense":
            distinct = self.frame.df.select(F.col(k).alias("value")).filter("value IS NOT NULL").distinct()
            ranks = running_total(distinct, ["value"]).select("value", F.lit(1).alias("n"), (F.col("before") + 1).alias("rank"))
        else:
            ranks = value_ranks(self.frame.df, F.col(k))
        at = {"average": F.col("rank"), "dense": F.col("rank"), "min": F.col("rank") - (n - 1) / 2, "max": F.col("rank") + (n - 1) / 2}[how]
        table = ranks.select(F.col("value").alias(f"{out}k"), at.cast("double").alias(out), n.alias(f"{out}n"))
        if share:
            total = self.frame.df.agg(F.count(k).cast("double").alias(f"{out}t"))
            table = table.crossJoin(F.broadcast(total)).withColumn(out, F.col(out) / F.col(f"{out}t")).drop(f"{out}t")
        self.frame.df = self.frame.df.join(table.drop(f"{out}n"), F.col(k) == F.col(f"{out}k"), "left").drop(f"{out}k")
        return Value(F.col(out))

    # -- expressions ----------------------------------------------------------------
    def names_of(self, node: ast.expr) -> list[str] | None:
        """A list of column names that is known when the program is compiled."""
        if isinstance(node, (ast.List, ast.Tuple)):
            found = [self.expr(x) for x in node.elts]
            return found if found and all(isinstance(x, str) for x in found) else None
        if isinstance(node, ast.Name) and isinstance(self.locals.get(node.id), list):
            found = self.locals[node.id]
            return found if all(isinstance(x, str) for x in found) else None
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            parts = [self.names_of(x) for x in (node.left, node.right)]
            return None if None in parts else parts[0] + parts[1]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("list", "sorted") and len(node.args) == 1 and not node.keywords:
            names = list(self.frame.columns) if self.is_frame(node.args[0]) else self.names_of(node.args[0])
            return sorted(names) if names and node.func.id == "sorted" else names
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("tolist", "to_list") and not node.args:
            return self.names_of(node.func.value)
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Slice):
            names = self.names_of(node.value)
            ends = [None if x is None else self.expr(x) for x in (node.slice.lower, node.slice.upper)]
            if names is not None and node.slice.step is None and all(x is None or isinstance(x, int) for x in ends):
                return names[slice(*ends)]
        if isinstance(node, ast.Attribute) and node.attr == "columns":
            if isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and node.value.func.attr == "select_dtypes":
                return [c for c in self.frame.columns if c in self.numbers]
            if self.is_frame(node.value):
                return list(self.frame.columns)
        if isinstance(node, ast.ListComp) and len(node.generators) == 1 and isinstance(node.elt, ast.Name):
            g = node.generators[0]
            base = self.names_of(g.iter)
            if base is not None and isinstance(g.target, ast.Name) and node.elt.id == g.target.id:
                return [c for c in base if all(self.test_name(t, g.target.id, c) for t in g.ifs)]
        return None

    def test_name(self, node: ast.expr, var: str, name: str) -> bool:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == var and node.func.attr in ("startswith", "endswith") and len(node.args) == 1:
            part = self.expr(node.args[0])
            return name.startswith(part) if node.func.attr == "startswith" else name.endswith(part)
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            left, right = node.left, node.comparators[0]
            if isinstance(left, ast.Name) and left.id == var:
                names = self.names_of(right)
                if isinstance(node.ops[0], (ast.In, ast.NotIn)) and names is not None:
                    return (name in names) == isinstance(node.ops[0], ast.In)
                if isinstance(node.ops[0], (ast.Eq, ast.NotEq)):
                    return (name == self.expr(right)) == isinstance(node.ops[0], ast.Eq)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return not self.test_name(node.operand, var, name)
        if isinstance(node, ast.BoolOp):
            return (all if isinstance(node.op, ast.And) else any)(self.test_name(v, var, name) for v in node.values)
        raise UnsupportedProgram("condition on names")

    def known(self, node: ast.expr) -> bool | None:
        """The truth of a condition on names and constants, or null where rows decide."""
        if isinstance(node, ast.BoolOp):
            parts = [self.known(x) for x in node.values]
            return None if None in parts else (all if isinstance(node.op, ast.And) else any)(parts)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            found = self.known(node.operand)
            return None if found is None else not found
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("all", "any") and len(node.args) == 1 and isinstance(node.args[0], ast.GeneratorExp):
            of, (g, *more) = node.args[0], node.args[0].generators
            names = self.names_of(g.iter)
            if more or names is None or g.ifs or not isinstance(g.target, ast.Name):
                return None
            kept, parts = dict(self.locals), []
            for name in names:
                self.locals[g.target.id] = name
                parts.append(self.known(of.elt))
            self.locals = kept
            return None if None in parts else (all if node.func.id == "all" else any)(parts)
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            left, right = node.left, node.comparators[0]
            if isinstance(node.ops[0], (ast.In, ast.NotIn)):
                of = self.frame.columns if self.is_frame(right) else self.names_of(right)
                name = self.expr(left)
                return (name in of) == isinstance(node.ops[0], ast.In) if of is not None and isinstance(name, str) else None
            a, b = self.constant(left), self.constant(right)
            if a is not None and b is not None and isinstance(a, str) == isinstance(b, str):
                return {ast.Gt: a > b, ast.GtE: a >= b, ast.Lt: a < b, ast.LtE: a <= b, ast.Eq: a == b, ast.NotEq: a != b}.get(type(node.ops[0]))
        return None

    def constant(self, node: ast.expr) -> int | float | str | None:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "len" and len(node.args) == 1:
            names = self.names_of(node.args[0])
            return len(names) if names is not None else None
        if isinstance(node, ast.Constant) or isinstance(node, ast.Name) and not isinstance(self.locals.get(node.id, []), (list, Value)):
            found = self.expr(node)
            return found if isinstance(found, (int, float, str)) else None
        return None

    def is_frame(self, node: ast.expr) -> bool:
        return isinstance(node, ast.Name) and node.id in self.frames

    def expr(self, node: ast.expr) -> object:
        method = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if method is None:
            raise UnsupportedProgram(type(node).__name__)
        return method(node)

    def on_constant(self, node: ast.Constant) -> object:
        if node.value is None or isinstance(node.value, (bool, int, float, str)):
            return node.value
        raise UnsupportedProgram("constant")

    def on_name(self, node: ast.Name) -> object:
        if node.id in self.locals:
            return self.locals[node.id]
        raise UnsupportedProgram(f"name {node.id}")

    def on_subscript(self, node: ast.Subscript) -> object:
        if self.is_frame(node.value):
            names = self.names_of(node.slice)
            if names is not None:
                return Columns([self.column(c) for c in names], names)
            name = self.expr(node.slice)
            if isinstance(name, str):
                return self.column(name)
        if isinstance(node.value, ast.Attribute) and node.value.attr == "shape" and self.is_frame(node.value.value) and isinstance(node.slice, ast.Constant) and node.slice.value == 0:
            return self.statistics(Value(F.lit(1.0)), F.count)[0]
        base = self.expr(node.value)
        if isinstance(base, Columns):
            if isinstance(node.slice, ast.Tuple) and len(node.slice.elts) == 2 and isinstance(node.slice.elts[0], ast.Slice):
                at = self.expr(node.slice.elts[1])
            else:
                at = self.expr(node.slice)
            if isinstance(at, str) and at in base.names:
                return base[base.names.index(at)]
            if isinstance(at, int) and -len(base) <= at < len(base):
                return base[at]
        elif isinstance(base, (list, dict)):
            at = self.expr(node.slice)
            if isinstance(base, list) and isinstance(at, int) and -len(base) <= at < len(base) or isinstance(base, dict) and at in base:
                return base[at]
        raise UnsupportedProgram("subscript")

    def on_list(self, node: ast.List) -> list:
        return [self.expr(x) for x in node.elts]

    on_tuple = on_set = on_list

    def on_dict(self, node: ast.Dict) -> dict:
        if None in node.keys:
            raise UnsupportedProgram("dict")
        return {self.expr(k): self.expr(v) for k, v in zip(node.keys, node.values)}

    def on_joinedstr(self, node: ast.JoinedStr) -> str:
        parts = [x.value if isinstance(x, ast.Constant) else self.expr(x.value) if x.format_spec is None else None for x in node.values]
        if not all(isinstance(x, (str, int)) for x in parts):
            raise UnsupportedProgram("a text made of rows' values")
        return "".join(map(str, parts))

    def on_boolop(self, node: ast.BoolOp) -> object:
        if (found := self.known(node)) is not None:
            return found
        tests = [F.coalesce(self.number(self.expr(x)), F.lit(0.0)) != 0 for x in node.values]
        made = tests[0]
        for t in tests[1:]:
            made = made & t if isinstance(node.op, ast.And) else made | t
        return Value(made.cast("double"))

    def called_with(self, function: ast.expr, argument: object) -> object:
        """The value of a lambda, or of a named function, of one argument."""
        if isinstance(function, ast.Lambda) and len(function.args.args) == 1 and not function.args.defaults:
            name, kept, frames = function.args.args[0].arg, dict(self.locals), set(self.frames)
            if argument is self.frame:
                self.frames.add(name)
            else:
                self.frames.discard(name)
                self.locals[name] = argument
            found = self.expr(function.body)
            self.locals, self.frames = kept, frames
            return found
        name = function.attr if isinstance(function, ast.Attribute) else function.id if isinstance(function, ast.Name) else None
        if isinstance(argument, Columns) and name in POPULATION:
            return Value(N.finite(POPULATION[name]([self.number(c) for c in argument])))
        if isinstance(argument, Columns) and name in REDUCERS:
            return Value(N.finite(REDUCERS[name]([self.number(c) for c in argument])))
        if isinstance(argument, Value) and name in UNARY:
            return Value(N.finite(UNARY[name](self.number(argument))))
        if isinstance(argument, Value) and name in ("str", "len", "float", "int"):
            return {"str": Value(argument.col.cast("string"), True), "len": Value(F.length(argument.col).cast("double"))}.get(name) or Value(self.number(argument))
        raise UnsupportedProgram("apply of a function that isn't a lambda of one argument")

    def on_attribute(self, node: ast.Attribute) -> object:
        if self.is_frame(node.value) and node.attr in self.frame.columns:
            return self.column(node.attr)
        if isinstance(node.value, ast.Name) and node.value.id in ("np", "numpy", "math") and node.attr in ("pi", "e", "nan", "inf"):
            return {"pi": math.pi, "e": math.e}.get(node.attr, Value(F.lit(None).cast("double")))
        raise UnsupportedProgram(f"attribute {node.attr}")

    def on_unaryop(self, node: ast.UnaryOp) -> object:
        x = self.expr(node.operand)
        if isinstance(x, (int, float)) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -x if isinstance(node.op, ast.USub) else x
        if isinstance(node.op, ast.USub):
            return Value(-self.number(x))
        if isinstance(node.op, (ast.Invert, ast.Not)):
            return Value((F.coalesce(self.number(x), F.lit(0.0)) == 0).cast("double"))
        return x

    def on_binop(self, node: ast.BinOp) -> object:
        return self.combined(node.op, self.expr(node.left), self.expr(node.right))

    def combined(self, op: ast.operator, a: object, b: object) -> object:
        if isinstance(a, list) and isinstance(b, list) and isinstance(op, ast.Add):
            return a + b
        if isinstance(a, str) and isinstance(b, str) and isinstance(op, ast.Add):
            return a + b
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            try:
                return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Pow: lambda: float(a) ** b}[type(op)]()
            except (KeyError, ZeroDivisionError, OverflowError):
                raise UnsupportedProgram("constant arithmetic") from None
        if isinstance(op, ast.Add) and any(isinstance(x, str) or isinstance(x, Value) and x.text for x in (a, b)):
            return Value(F.concat(self.value(a).col.cast("string"), self.value(b).col.cast("string")), True)
        x, y = self.number(a), self.number(b)
        made = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: N.divide(x, y), ast.Pow: lambda: F.pow(x, y), ast.Mod: lambda: F.pmod(x, F.nullif(y, F.lit(0.0))), ast.FloorDiv: lambda: F.floor(N.divide(x, y)).cast("double"),
                ast.BitAnd: lambda: ((F.coalesce(x, F.lit(0.0)) != 0) & (F.coalesce(y, F.lit(0.0)) != 0)).cast("double"), ast.BitOr: lambda: ((F.coalesce(x, F.lit(0.0)) != 0) | (F.coalesce(y, F.lit(0.0)) != 0)).cast("double")}.get(type(op))
        if made is None:
            raise UnsupportedProgram(type(op).__name__)
        return Value(N.finite(made()))

    def on_compare(self, node: ast.Compare) -> object:
        if (found := self.known(node)) is not None:
            return found
        sides, made = [self.expr(x) for x in (node.left, *node.comparators)], None
        for op, a, b in zip(node.ops, sides, sides[1:]):
            if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, list):
                test = self.among(self.value(a), b)
                test = ~test if isinstance(op, ast.NotIn) else test
            elif isinstance(op, (ast.In, ast.NotIn)):
                test = F.coalesce(F.contains(self.value(b).col, self.value(a).col), F.lit(False))
                test = ~test if isinstance(op, ast.NotIn) else test
            else:
                test = self.compared(op, a, b)
            made = test if made is None else made & test
        return Value(made.cast("double"))

    def compared(self, op: ast.cmpop, a: object, b: object) -> Column:
        a, b = self.value(a), self.value(b)
        x, y = (a.col, b.col) if a.text and b.text else (self.number(a), self.number(b))
        made = {ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y, ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Eq: lambda: x == y, ast.NotEq: lambda: ~x.eqNullSafe(y) | x.isNull()}.get(type(op))
        if made is None:
            raise UnsupportedProgram(type(op).__name__)
        return F.coalesce(made(), F.lit(False))  # a comparison with a missing value is false

    def among(self, value: Value, of: list) -> Column:
        same = [x for x in of if isinstance(x, str) == value.text and isinstance(x, (str, int, float))]
        if len(of) != len([x for x in of if isinstance(x, (str, int, float))]):
            raise UnsupportedProgram("isin of rows' values")
        return F.coalesce((value.col if value.text else self.number(value)).isin(same), F.lit(False)) if same else F.lit(False)

    def on_ifexp(self, node: ast.IfExp) -> object:
        if (found := self.known(node.test)) is not None:
            return self.expr(node.body if found else node.orelse)
        return self.chosen(self.expr(node.test), self.expr(node.body), self.expr(node.orelse))

    def chosen(self, test: object, a: object, b: object) -> Value:
        one, other = self.value(a), self.value(b)
        if one.text != other.text:
            raise UnsupportedProgram("a choice of text and number")
        return Value(F.when(self.number(test) != 0, one.col).otherwise(other.col), one.text)

    def on_call(self, node: ast.Call) -> object:
        options = {k.arg: k.value for k in node.keywords}
        if isinstance(node.func, ast.Name):
            return self.function(node.func.id, node, options)
        if not isinstance(node.func, ast.Attribute):
            raise UnsupportedProgram("call")
        of, name = node.func.value, node.func.attr
        module = ast.unparse(of)
        if module in ("np", "numpy"):
            return self.numpy(name, node, options)
        if module in ("math", "stats", "scipy.stats", "preprocessing", "sklearn.preprocessing", "pd", "special"):
            return self.function(name, node, options)
        if self.is_frame(of):
            if name == "copy":
                return of.id
            if name == "select_dtypes":
                names = [c for c in self.frame.columns if c in self.numbers]
                return Columns([self.column(c) for c in names], names)
            if name == "apply" and node.args and self.axis(node, options, 1) == 1:
                return self.called_with(node.args[0], self.frame)
            if name in REDUCERS and self.axis(node, options, 0) == 1:
                names = [c for c in self.frame.columns if c in self.numbers]
                return Value(N.finite(REDUCERS[name]([self.number(self.column(c)) for c in names])))
            raise UnsupportedProgram(f"frame.{name}")
        special = self.group_call(of, name, node)
        if special is not None:
            return special
        if isinstance(of, ast.Attribute) and of.attr == "str":
            return self.of_text(self.value(self.expr(of.value)), name, [self.expr(a) for a in node.args])
        base = self.expr(of)
        if isinstance(base, Scaling):
            if name in ("fit_transform", "transform") and node.args:
                return self.scale_all(base.kind, self.expr(node.args[0]))
            if name == "fit":
                return base
        if isinstance(base, (Counts, GroupTable, dict)) and name in ("to_dict", "copy"):
            return base
        if isinstance(base, list):
            if name in ("flatten", "ravel", "squeeze", "copy", "to_numpy", "reshape"):
                return base
            if not isinstance(base, Columns):
                raise UnsupportedProgram(f"list.{name}")
            by_row = base.row or self.axis(node, options, 0) == 1
            if name == "apply" and node.args and by_row:
                return self.called_with(node.args[0], Columns(list(base), base.names, True))
            if name in REDUCERS and by_row:
                return Value(N.finite(REDUCERS[name]([self.number(c) for c in base])))
            if name == "nunique" and by_row:
                return Value(F.size(F.array_distinct(F.array_compact(F.array(*[self.number(c) for c in base])))).cast("double"))
            if name == "fillna" and len(node.args) == 1:
                other = self.value(self.expr(node.args[0]))
                return Columns([Value(F.coalesce(c.col, other.col), c.text) for c in base], base.names)
            if name in ("abs", "astype", "clip", "round"):
                return Columns([self.method(c, name, node, options) for c in base], base.names)
            raise UnsupportedProgram(f"columns.{name}")
        return self.method(self.value(base), name, node, options)

    def axis(self, node: ast.Call, options: dict[str, ast.expr], usual: int) -> int:
        given = self.expr(options["axis"]) if "axis" in options else usual
        return 1 if given in (1, "columns") else 0

    def scale_all(self, kind: str, of: object) -> object:
        if isinstance(of, list) and of and all(isinstance(x, Value) for x in of):
            return Columns([self.scaled(kind, x) for x in of], getattr(of, "names", [str(k) for k in range(len(of))]))
        return self.scaled(kind, self.value(of))

    def function(self, name: str, node: ast.Call, options: dict[str, ast.expr]) -> object:
        if name in SCALERS and not node.args:
            return Scaling(SCALERS[name])
        if name == "len" and len(node.args) == 1:
            if self.is_frame(node.args[0]):
                return self.statistics(Value(F.lit(1.0)), F.count)[0]
            names = self.names_of(node.args[0])
            if names is not None:
                return len(names)
        if name in ("combinations", "range", "enumerate", "zip") and node.args:
            return self.sequence(node)
        args = [self.expr(a) for a in node.args]
        if name in SCALERS:
            return self.scale_all(SCALERS[name], args[0])
        if name in POPULATION and args and isinstance(args[0], Columns) and (args[0].row or self.axis(node, options, 0) == 1):
            return Value(N.finite(POPULATION[name]([self.number(c) for c in args[0]])))
        if name in ("skew", "kurtosis") and len(args) == 1 and not isinstance(args[0], Columns):
            return self.statistics(self.value(args[0]), F.skewness if name == "skew" else F.kurtosis)[0]
        if name == "rankdata" and args:
            return self.rank(self.value(args[0]), False, self.expr(options["method"]) if "method" in options else "average")
        if name == "abs" and len(args) == 1:
            return Value(F.abs(self.number(args[0])))
        if name in UNARY and len(args) == 1:
            return Value(N.finite(UNARY[name](self.number(args[0]))))
        if name in ("float", "int", "str") and len(args) == 1 and not isinstance(args[0], Value):
            return {"float": float, "int": int, "str": str}[name](args[0])
        if name in ("float", "int", "bool") and len(args) == 1:
            c = self.number(args[0])
            return Value({"float": c, "int": F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double"), "bool": (c != 0).cast("double")}[name])
        if name == "len" and isinstance(args[0], Value):
            return Value(F.length(args[0].col.cast("string")).cast("double"))
        if name == "round" and 1 <= len(args) <= 2 and isinstance(args[0], Value):
            return Value(F.bround(self.number(args[0]), int(args[1]) if len(args) > 1 else 0))
        if name in ("max", "min") and len(args) > 1:
            return Value((F.greatest if name == "max" else F.least)(*map(self.number, args)))
        if name in ("isna", "isnull", "notna", "notnull", "isnan") and len(args) == 1:
            return Value((self.value(args[0]).col.isNotNull() if name.startswith("not") else self.value(args[0]).col.isNull()).cast("double"))
        if name == "to_numeric" and args:
            return Value(self.number(args[0]))
        if name == "pow" and len(args) == 2:
            return self.combined(ast.Pow(), *args)
        raise UnsupportedProgram(f"function {name}")

    def sequence(self, node: ast.expr) -> list:
        """What a for statement goes over, as far as it is known when the program is compiled."""
        names = self.names_of(node)
        if names is not None:
            return names
        if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            if name == "range":
                ends = [self.expr(a) for a in node.args]
                if ends and all(isinstance(x, int) for x in ends) and len(range(*ends)) <= STATEMENTS:
                    return list(range(*ends))
                raise UnsupportedProgram("range")
            if name in ("combinations", "enumerate", "zip", "items"):
                of = [self.sequence(a) for a in node.args if not (isinstance(a, ast.Constant) and isinstance(a.value, int))]
                if name == "items" and isinstance(found := self.expr(node.func.value), dict):
                    return [list(x) for x in found.items()]
                if name == "enumerate":
                    return [list(x) for x in enumerate(of[0])]
                if name == "zip":
                    return [list(x) for x in zip(*of)]
                if name == "combinations":
                    return [list(x) for x in itertools.islice(itertools.combinations(of[0], self.expr(node.args[1])), STATEMENTS)]
        found = self.expr(node)
        if isinstance(found, list) and not isinstance(found, Columns):
            return found
        raise UnsupportedProgram("a loop over rows")

    def of_text(self, value: Value, name: str, args: list) -> Value:
        c = value.col.cast("string")
        made = {"len": lambda: Value(F.length(c).cast("double")), "lower": lambda: Value(F.lower(c), True), "upper": lambda: Value(F.upper(c), True), "strip": lambda: Value(F.trim(c), True)}.get(name)
        if made and not args:
            return made()
        if len(args) == 1 and isinstance(args[0], str):
            pattern = F.lit(args[0])
            tests = {"contains": lambda: c.rlike(args[0]), "startswith": lambda: c.startswith(args[0]), "endswith": lambda: c.endswith(args[0])}
            if name in tests:
                return Value(F.coalesce(tests[name](), F.lit(False)).cast("double"))
            if name == "count":
                return Value(F.regexp_count(c, pattern).cast("double"))
        raise UnsupportedProgram(f"str.{name}")

    def numpy(self, name: str, node: ast.Call, options: dict[str, ast.expr]) -> object:
        args = [self.expr(a) for a in node.args]
        if name == "where" and len(args) == 3:
            return self.chosen(*args)
        if name == "select" and len(args) >= 2 and all(isinstance(x, list) for x in args[:2]):
            out = args[2] if len(args) > 2 else self.expr(options["default"]) if "default" in options else 0
            for test, value in zip(args[0][::-1], args[1][::-1]):
                out = self.chosen(test, value, out)
            return out
        if args and isinstance(args[0], Columns):
            if name in REDUCERS and self.axis(node, options, 0) == 1:
                ddof0 = {"std": lambda cs: N.row_std(cs, 0), "var": lambda cs: N.row_var(cs, 0)}
                return Value(N.finite(ddof0.get(name, REDUCERS[name])([self.number(c) for c in args[0]])))
            if name in UNARY:
                return Columns([Value(N.finite(UNARY[name](self.number(c)))) for c in args[0]], args[0].names)
        if name in UNARY and len(args) == 1:
            return Value(N.finite(UNARY[name](self.number(args[0]))))
        if name in ("maximum", "minimum", "fmax", "fmin") and len(args) == 2:
            return Value((F.greatest if "max" in name else F.least)(*map(self.number, args)))
        if name in OPERATORS and len(args) == 2:
            return self.combined(OPERATORS[name](), *args)
        if name in COMPARISONS and len(args) == 2:
            return Value(self.compared(COMPARISONS[name](), *args).cast("double"))
        if name in ("logical_and", "logical_or") and len(args) == 2:
            return self.combined((ast.BitAnd if name == "logical_and" else ast.BitOr)(), *args)
        if name == "logical_not" and len(args) == 1:
            return Value((F.coalesce(self.number(args[0]), F.lit(0.0)) == 0).cast("double"))
        if name == "clip" and len(args) == 3:
            return self.clipped(*args)
        if name == "nan_to_num" and args:
            return Value(F.coalesce(self.number(args[0]), F.lit(0.0)))
        if name == "polyval" and len(args) == 2 and isinstance(args[0], list):
            out = Value(F.lit(0.0))
            for factor in args[0]:
                out = self.combined(ast.Add(), self.combined(ast.Mult(), out, args[1]), factor)
            return out
        if name in ("percentile", "nanpercentile", "quantile", "nanquantile") and len(args) == 2 and isinstance(args[1], (int, float)):
            return self.quantiles(self.value(args[0]), args[1] / (100 if "percentile" in name else 1))[0]
        if name in ("isin", "in1d") and len(args) == 2 and isinstance(args[1], list):
            return Value(self.among(self.value(args[0]), args[1]).cast("double"))
        if name in ("std", "var") and len(args) == 1:
            return self.statistics(self.value(args[0]), F.stddev_pop if name == "std" else F.var_pop)[0]
        if name.removeprefix("nan") in (*STATISTICS, "median") and len(args) == 1:
            return self.statistic(self.value(args[0]), name.removeprefix("nan"))
        if name in ("array", "asarray", "float64") and len(args) == 1:
            return args[0]
        raise UnsupportedProgram(f"np.{name}")

    def grouped(self, node: ast.expr) -> tuple[Value, Value] | None:
        """(key, value) of frame.groupby(key)[value]."""
        if not (isinstance(node, ast.Subscript) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and node.value.func.attr == "groupby" and self.is_frame(node.value.func.value)):
            return None
        if len(node.value.args) != 1:
            raise UnsupportedProgram("groupby")
        keys = self.names_of(node.value.args[0]) or [self.expr(node.value.args[0])]
        parts = [self.column(k) if isinstance(k, str) else self.value(k) for k in keys]
        key = parts[0] if len(parts) == 1 else Value(F.when(F.concat(*[p.col.cast("string") for p in parts]).isNotNull(), F.to_json(F.array(*[p.col.cast("string") for p in parts]))), True)
        return key, self.column(self.expr(node.slice))

    def group_call(self, of: ast.expr, name: str, node: ast.Call) -> object | None:
        """frame.groupby(k)[v].transform(f), .rank() and .mean() and the like; x.value_counts(); x.map of a table, a dict or a function."""
        if (found := self.grouped(of)) is not None:
            key, value = found
            if name == "rank":
                return self.of_group(key, value, "rank")
            if name in ("transform", "agg", "aggregate") and node.args:
                if isinstance(node.args[0], ast.Lambda):
                    if name != "transform":
                        raise UnsupportedProgram("agg of a function")
                    return self.called_with(node.args[0], Value(value.col, value.text, key))
                how = self.expr(node.args[0])
                if not isinstance(how, str) or how not in (*STATISTICS, "median", "rank"):
                    raise UnsupportedProgram(f"transform {how}")
                return self.of_group(key, value, how) if name == "transform" else GroupTable(key, value, how)
            if name in (*STATISTICS, "median"):
                return GroupTable(key, value, name)
            raise UnsupportedProgram(f"groups' {name}")
        if name == "value_counts":
            share = any(k.arg == "normalize" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
            return Counts(self.value(self.expr(of)), share)
        if name in ("map", "apply") and len(node.args) == 1 and not self.is_frame(of) and not isinstance(base := self.expr(of), list):
            value, inner = self.value(base), node.args[0]
            if isinstance(inner, ast.Lambda) or isinstance(inner, (ast.Name, ast.Attribute)) and ast.unparse(inner).split(".")[-1] in (*UNARY, "str", "len", "float", "int") and ast.unparse(inner) not in self.locals:
                return self.value(self.called_with(inner, value))
            table = self.expr(inner)
            if isinstance(table, Counts):
                return self.frequency(table.value, table.share, value)
            if isinstance(table, GroupTable):
                return self.of_group(table.key, table.value, table.how, value)
            if isinstance(table, dict) and table:
                return self.looked_up(value, table)
            raise UnsupportedProgram("map")
        return None

    def looked_up(self, value: Value, table: dict, otherwise: Value | None = None) -> Value:
        made = [(self.compared(ast.Eq(), value, k), self.value(v)) for k, v in table.items()]
        kinds = {v.text for _, v in made}
        if len(kinds) > 1 or otherwise is not None and otherwise.text not in kinds:
            raise UnsupportedProgram("a table of texts and numbers")
        out = F.when(made[0][0], made[0][1].col)
        for test, v in made[1:]:
            out = out.when(test, v.col)
        return Value(out if otherwise is None else out.otherwise(otherwise.col), kinds.pop())

    def clipped(self, x: object, low: object, high: object) -> Value:
        c = self.number(x)
        if low is not None:
            c = F.when(c.isNotNull(), F.greatest(c, self.number(low)))
        if high is not None:
            c = F.when(c.isNotNull(), F.least(c, self.number(high)))
        return Value(c)

    def method(self, value: Value, name: str, node: ast.Call, options: dict[str, ast.expr]) -> object:
        if name == "astype":
            kind = ast.unparse(node.args[0]) if node.args else "float"
            if kind in ("str", "'str'"):
                return Value(value.col.cast("string"), True)
            c = self.number(value)
            return Value(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double") if "int" in kind else c)
        args = [self.expr(a) for a in node.args]
        given = {k: self.expr(v) for k, v in options.items()}
        if name in ("to_numpy", "reset_index", "copy", "flatten", "ravel", "reshape", "squeeze"):
            return value
        if name == "fillna" and len(args) == 1:
            other = self.value(args[0])
            return Value(F.coalesce(value.col, other.col), value.text)
        if name == "clip":
            low = args[0] if args else given.get("lower")
            high = args[1] if len(args) > 1 else given.get("upper")
            return self.clipped(value, low, high)
        if name == "rank":
            return self.rank(value, bool(given.get("pct", False)), given.get("method", "average"), bool(given.get("ascending", True)))
        if name == "round":
            return Value(F.bround(self.number(value), int(args[0]) if args else 0))
        if name in OPERATORS and len(args) == 1:
            return self.combined(OPERATORS[name](), value, args[0])
        if name in COMPARISONS and len(args) == 1:
            return Value(self.compared(COMPARISONS[name](), value, args[0]).cast("double"))
        if name == "abs":
            return Value(F.abs(self.number(value)))
        if name == "between" and len(args) == 2:
            return Value((self.compared(ast.GtE(), value, args[0]) & self.compared(ast.LtE(), value, args[1])).cast("double"))
        if name == "replace" and len(args) == 1 and isinstance(args[0], dict) and args[0]:
            return self.looked_up(value, args[0], value)
        if name == "replace" and len(args) == 2:
            olds = args[0] if isinstance(args[0], list) else [args[0]]
            new = self.value(args[1])
            old = [x for x in olds if isinstance(x, (str, int, float))]
            if new.text != value.text and not (new.col is not None and args[1] is None):
                raise UnsupportedProgram("replace of text and number")
            return Value(F.when(self.among(value, old), new.col).otherwise(value.col), value.text) if old else value
        if name == "isin" and len(args) == 1 and isinstance(args[0], list):
            return Value(self.among(value, args[0]).cast("double"))
        if name == "quantile":
            return self.quantiles(value, args[0] if args else given.get("q", 0.5))[0]
        if name in ("isna", "isnull", "notna", "notnull"):
            return Value((value.col.isNull() if name.startswith("is") else value.col.isNotNull()).cast("double"))
        if name in (*STATISTICS, "median"):
            if name in ("std", "var") and given.get("ddof", 1) == 0 and value.group is None:
                return self.statistics(value, F.stddev_pop if name == "std" else F.var_pop)[0]
            return self.statistic(value, name)
        raise UnsupportedProgram(f"method {name}")

    # -- statements -------------------------------------------------------------------
    def run(self) -> DataFrame:
        for statement in self.fn.body:
            if isinstance(statement, ast.Return):
                if not (isinstance(statement.value, ast.Name) and statement.value.id in self.frames):
                    raise UnsupportedProgram("return of something else than the frame")
                break
            self.statement(statement)
        return self.frame.df if self.dry else self.frame.df.select(*[F.col(f"`{c}`") for c in self.frame.columns])

    def statement(self, node: ast.stmt) -> None:
        self.left -= 1
        if self.left < 0:
            raise UnsupportedProgram(f"more than {STATEMENTS} statements")
        if isinstance(node, (ast.Import, ast.ImportFrom, ast.Pass)) or isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant):
            return  # what is imported has a meaning here by its usual name
        if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and node.value.func.attr == "fit" and isinstance(self.expr(node.value.func.value), Scaling):
            return  # it is fitted where it is applied
        if isinstance(node, ast.For) and not node.orelse:
            for item in self.sequence(node.iter):
                self.bind(node.target, item)
                for s in node.body:
                    if isinstance(s, ast.Continue):
                        break
                    self.statement(s)
            return
        if isinstance(node, ast.AugAssign):
            target = node.target
            if isinstance(target, ast.Subscript) and self.is_frame(target.value) and isinstance(name := self.expr(target.slice), str):
                self.assign(name, self.combined(node.op, self.column(name), self.expr(node.value)))
                return
            if isinstance(target, ast.Name) and target.id in self.locals:
                self.locals[target.id] = self.combined(node.op, self.locals[target.id], self.expr(node.value))
                return
        if isinstance(node, ast.If):
            found = self.known(node.test)
            if found is None:
                raise UnsupportedProgram("if")
            for part in node.body if found else node.orelse:
                self.statement(part)
            return
        if not isinstance(node, ast.Assign) or len(node.targets) != 1:
            raise UnsupportedProgram(type(node).__name__)
        target, value = node.targets[0], node.value
        if isinstance(target, ast.Name):
            if self.is_frame(value) or isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and self.is_frame(value.func.value) and value.func.attr == "copy":
                self.frames.add(target.id)
            elif isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and self.is_frame(value.func.value) and target.id in self.frames:
                self.whole_frame(value)
            else:
                names = self.names_of(value)
                self.locals[target.id] = names if names is not None else self.expr(value)
                self.frames.discard(target.id)
            return
        if isinstance(target, (ast.Tuple, ast.List)):
            self.bind(target, self.expr(value))
            return
        if isinstance(target, ast.Subscript) and isinstance(target.value, ast.Attribute) and target.value.attr == "loc" and self.is_frame(target.value.value) and isinstance(target.slice, ast.Tuple) and len(target.slice.elts) == 2:
            where, name = target.slice.elts[0], self.expr(target.slice.elts[1])
            if isinstance(name, str):
                new = self.value(self.expr(value))
                if not isinstance(where, ast.Slice):
                    old = self.column(name) if name in self.frame.columns else Value(F.lit(None).cast("string" if new.text else "double"), new.text)
                    new = self.chosen(self.expr(where), new, old)
                self.assign(name, new)
                return
        if isinstance(target, ast.Subscript) and self.is_frame(target.value):
            names = self.names_of(target.slice)
            if names is None:
                name = self.expr(target.slice)
                if not isinstance(name, str):
                    raise UnsupportedProgram("name of a column")
                self.assign(name, self.expr(value))
                return
            if isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and value.func.attr == "fillna" and isinstance(value.func.value, ast.Subscript) and self.names_of(value.func.value.slice) == names:
                with_what = self.value(self.expr(value.args[0]))
                for c in names:
                    v = self.column(c)
                    self.assign(c, Value(F.coalesce(v.col, with_what.col), v.text))
                return
            made = self.expr(value)
            if isinstance(made, list) and len(made) == len(names):
                held = [(c, Value(F.col(self.held(v)), v.text) if not self.dry else v) for c, v in zip(names, map(self.value, made))]
                for c, v in held:  # all are made before any is replaced
                    self.assign(c, v)
                return
        raise UnsupportedProgram("assignment")

    def bind(self, target: ast.expr, item: object) -> None:
        if isinstance(target, ast.Name):
            self.locals[target.id] = item
            self.frames.discard(target.id)
        elif isinstance(target, (ast.Tuple, ast.List)) and isinstance(item, list) and len(item) == len(target.elts):
            for t, x in zip(target.elts, item):
                self.bind(t, x)
        else:
            raise UnsupportedProgram("unpacking")

    def whole_frame(self, call: ast.Call) -> None:
        if call.func.attr == "fillna" and len(call.args) == 1:
            number = self.expr(call.args[0])
            if isinstance(number, (int, float)):
                of = [c for c in self.frame.columns if c in self.numbers]
                if not self.dry:
                    self.frame.df = self.frame.df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(number).cast(self.types[c] if c in self.types and c not in self.frame.made else T.DoubleType())) for c in of})
                return
        if call.func.attr == "assign" and not call.args:
            for k in call.keywords:
                if k.arg is None:
                    raise UnsupportedProgram("frame.assign")
                self.assign(k.arg, self.called_with(k.value, self.frame) if isinstance(k.value, ast.Lambda) else self.expr(k.value))
            return
        if call.func.attr == "drop":
            columns = next((k.value for k in call.keywords if k.arg == "columns"), call.args[0] if call.args else None)
            names = self.names_of(columns) if columns is not None else None
            if names is None and columns is not None:
                names = [self.expr(columns)]
            if names and all(isinstance(n, str) and n in self.frame.columns for n in names):
                self.frame.columns = [c for c in self.frame.columns if c not in names]
                return
        raise UnsupportedProgram(f"frame.{call.func.attr}")


@dataclass(frozen=True)
class FeatureProgram:
    """The text of a program; apply compiles it against a frame."""

    source: str

    def apply(self, df: DataFrame) -> DataFrame:
        """df with the program's columns. Raises UnsupportedProgram for what isn't in the language."""
        if calls_ancestor(self.source):
            raise UnsupportedProgram("it calls an earlier version")
        return _Compiler(function_of(self.source), df).run()

    def refusal(self, df: DataFrame) -> str | None:
        """Why the program can't be compiled against the columns of df, or null. Runs no job."""
        try:
            if calls_ancestor(self.source):
                return "it calls an earlier version"
            _Compiler(function_of(self.source), df, dry=True).run().schema
        except UnsupportedProgram as e:
            return str(e)
        except Exception as e:
            return f"analysis: {type(e).__name__}"
        return None

    def apply_or_keep(self, df: DataFrame) -> tuple[DataFrame, str | None]:
        """(frame, None), or df as it is and the reason."""
        try:
            out = self.apply(df)
            out.schema  # what analysis rejects shows here
            return out, None
        except UnsupportedProgram as e:
            return df, str(e)
        except Exception as e:  # analysis errors: a name or type that doesn't fit
            return df, f"analysis: {type(e).__name__}"


def _pieces(answer: str) -> list[str]:
    """The fenced parts of an answer, an open one to its end; without a fence the answer."""
    found, inside = [], None
    for line in answer.splitlines():
        if line.lstrip().startswith("```"):
            if inside is not None:
                found.append("\n".join(inside))
            inside = [] if inside is None else None
        elif inside is not None:
            inside.append(line)
    if inside:
        found.append("\n".join(inside))
    return found or [answer]


def strip_to_body(answer: str) -> str:
    """The body of the last function in the first part of an answer that has one, indented; empty without a function.

    The syntax tree tells where the function ends. A part that can't be parsed, as answers are cut off or badly indented, is read line by line: what follows the last
    header belongs to it up to another header at the margin, and lines at the margin get an indent.
    """
    for piece in _pieces(answer):
        try:
            functions = [n for n in ast.walk(ast.parse(textwrap.dedent(piece))) if isinstance(n, ast.FunctionDef) and n.col_offset == 0]
        except (SyntaxError, ValueError, RecursionError):
            functions = []
        if functions:
            last = max(functions, key=lambda n: n.lineno)
            header_end = last.body[0].lineno - 1 if last.body[0].lineno > last.lineno else last.lineno
            lines = textwrap.dedent(piece).splitlines()[: last.end_lineno]
            comments = next((k for k in range(header_end, last.lineno, -1) if not lines[k - 1].strip().startswith("#")), last.lineno)
            if last.body[0].lineno == last.lineno:  # the body stands behind the header
                return textwrap.indent("\n".join(ast.unparse(b) for b in last.body), "    ")
            return textwrap.indent(textwrap.dedent("\n".join(lines[comments:])), "    ")
        margin, body, inside = re.compile(r"(?:async )?def |class |```"), [], False
        for line in piece.splitlines():
            if re.match(r"\s*(?:async )?def \w", line):
                body, inside = [], True
            elif inside and margin.match(line):
                inside = False
            elif inside:
                body.append(line.rstrip() if not line.strip() or line[0] in " \t" else "    " + line.rstrip())
        if body:
            return "\n".join(body)
    return ""


def called_names(source: str) -> set[str]:
    """The names of all functions and methods that a program calls."""
    calls = (n.func for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Call))
    return {f.id if isinstance(f, ast.Name) else f.attr for f in calls if isinstance(f, (ast.Name, ast.Attribute))}


def rename_calls(source: str, old: str, new: str) -> str:
    """The program with calls of a function, and its definition, under another name."""
    tree = ast.parse(source)
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef) and node.name == old:
            node.name = new
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == old:
            node.func.id = new
    return ast.unparse(tree) + "\n"


def decorated(source: str, module: str, name: str) -> list[str]:
    """The functions of a text that are marked with @module.name."""
    return [n.name for n in ast.parse(source).body if isinstance(n, ast.FunctionDef) and f"{module}.{name}" in [ast.unparse(d) for d in n.decorator_list]]


@dataclass(frozen=True)
class Spec:
    """A search as stated by a text: the function to better, the one that judges it, and the text of the first."""

    evolve: str
    run: str
    seed_program: str


def spec_of(source: str) -> Spec:
    """The spec of a text with exactly one function marked @evaluate.run and one marked @equation.evolve; anything else is a ValueError."""
    try:
        run, evolve = decorated(source, "evaluate", "run"), decorated(source, "equation", "evolve")
    except SyntaxError as e:
        raise ValueError(f"the spec can't be parsed: {e}") from None
    if len(run) != 1 or len(evolve) != 1:
        raise ValueError(f"one function is to be marked @evaluate.run and one @equation.evolve, not {len(run)} and {len(evolve)}")
    fn = next(n for n in ast.parse(source).body if isinstance(n, ast.FunctionDef) and n.name == evolve[0])
    fn.decorator_list = []
    return Spec(evolve[0], run[0], ast.unparse(fn) + "\n")


def trim_body(body: str) -> str:
    """The longest beginning of a body, by whole lines, that parses within a function."""
    lines = body.splitlines()
    while lines:
        try:
            ast.parse("def f(df):\n" + "\n".join(lines) + "\n")
            return "\n".join(lines).rstrip() + "\n\n"
        except SyntaxError as e:
            cut = (e.lineno or len(lines) + 1) - 2
            lines = lines[: max(0, min(cut, len(lines) - 1))]
    return ""


def program_of(body: str, argument: str = "df_input") -> str:
    return f"def modify_features({argument}):\n{textwrap.indent(textwrap.dedent(body), '    ')}"


def canonical(source: str) -> str:
    """The program without docstrings, comments, and layout: equal texts are equal programs."""
    fn = function_of(source)
    body = [s for s in fn.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    return ast.unparse(ast.Module(body, []))
