"""Rules as data: a safe expression language compiled to columns, range requirements, weighted and ordered rule joins."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 10_000  # of an ordered rule table, which every row is compared with


class RuleError(ValueError):
    """A rule uses something that the language doesn't have."""


_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}
_SETS = {ast.BitAnd: F.array_intersect, ast.BitOr: F.array_union, ast.Sub: F.array_except}


def compile_rule(text: str, names: dict[str, Column], sets: frozenset[str] | set[str] = frozenset()) -> Column:
    """A column for a rule: and, or, not, chained comparisons, in, not in, set & | -, + - * /, abs len min max round sum.

    ``names`` are the columns a rule may read (dotted names included), ``sets`` those that hold arrays. Anything else
    is rejected before a plan exists. Conditions are evaluated lazily from the left; division by zero raises when it is
    reached.
    """
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as error:
        raise RuleError(f"not a rule: {text!r}") from error
    return _compile(tree.body, names, sets)[0]


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        inner = _dotted(node.value)
        return f"{inner}.{node.attr}" if inner else None
    return None


def _compile(node: ast.AST, names: dict[str, Column], sets: frozenset[str] | set[str]) -> tuple[Column, bool]:
    """The column and whether it is an array."""
    go = lambda n: _compile(n, names, sets)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool, type(None))):
        return F.lit(node.value), False
    if isinstance(node, (ast.Set, ast.List, ast.Tuple)):
        return F.array(*[go(x)[0] for x in node.elts]), True
    if isinstance(node, (ast.Name, ast.Attribute)):
        name = _dotted(node)
        if name not in names:
            raise RuleError(f"unknown name: {name}")
        return names[name], name in sets
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.USub)):
        inner = go(node.operand)[0]
        return (~inner if isinstance(node.op, ast.Not) else -inner), False
    if isinstance(node, ast.BoolOp):
        parts = [go(x)[0] for x in node.values]
        result = parts[-1]
        for part in reversed(parts[:-1]):  # lazily: the rest is only looked at if it matters
            result = F.when(part, result).otherwise(F.lit(False)) if isinstance(node.op, ast.And) else F.when(part, F.lit(True)).otherwise(result)
        return result, False
    if isinstance(node, ast.BinOp):
        (a, a_set), (b, b_set) = go(node.left), go(node.right)
        if a_set and b_set and type(node.op) in _SETS:
            return _SETS[type(node.op)](a, b), True
        if type(node.op) in _ARITHMETIC and not a_set and not b_set:
            return _ARITHMETIC[type(node.op)](a, b), False
        raise RuleError(f"operator not allowed: {ast.dump(node.op)}")
    if isinstance(node, ast.Compare):
        sides = [go(x) for x in [node.left, *node.comparators]]
        parts = []
        for op, (a, _), (b, b_set) in zip(node.ops, sides, sides[1:]):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not b_set:
                    raise RuleError("in needs a set")
                parts.append(F.array_contains(b, a) if isinstance(op, ast.In) else ~F.array_contains(b, a))
            elif type(op) in _COMPARE:
                parts.append(_COMPARE[type(op)](a, b))
            else:
                raise RuleError(f"comparison not allowed: {ast.dump(op)}")
        result = parts[0]
        for part in parts[1:]:
            result = result & part
        return result, False
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        arguments = [go(x) for x in node.args]
        columns = [c for c, _ in arguments]
        match node.func.id, len(arguments):
            case "abs", 1:
                return F.abs(columns[0]), False
            case "len", 1 if arguments[0][1]:
                return F.size(columns[0]), False
            case "round", 1 | 2 if len(columns) == 1 or isinstance(node.args[1], ast.Constant):
                return F.bround(columns[0], node.args[1].value if len(columns) == 2 else 0), False
            case ("min" | "max" | "sum") as name, 1 if arguments[0][1]:
                return {"min": F.array_min, "max": F.array_max, "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)}[name](columns[0]), False
            case ("min" | "max") as name, n if n > 1:
                return (F.least if name == "min" else F.greatest)(*columns), False
    raise RuleError(f"not allowed: {ast.dump(node)[:80]}")


def requirement_ranges(column: Column | str) -> Column:
    """Ranges of a requirement: ``1.5-3``, ``<=1``, ``>=2``, ``0``, several joined by ``or``; an array of (lo, hi)."""
    column = F.lower(column)

    def one(part: Column) -> Column:
        low, high = (F.regexp_extract(part, r"([0-9.]+) ?- ?([0-9.]+)", i).try_cast("double") for i in (1, 2))
        least, most = (F.regexp_extract(part, sign + r" ?([0-9.]+)", 1).try_cast("double") for sign in (">=", "<="))
        plain = F.regexp_extract(part, r"(?:^| )([0-9.]+) *$", 1).try_cast("double")
        lo = F.coalesce(low, least, F.when(most.isNotNull(), F.lit(float("-inf"))), plain)
        hi = F.coalesce(high, most, F.when(least.isNotNull(), F.lit(float("inf"))), plain)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.filter(F.transform(F.split(column, r" or "), one), lambda r: r["lo"].isNotNull())


def satisfied_share(axes: dict[str, tuple[Column, Column]], slack: float = 0.5) -> Column:
    """Share of the required axes whose value lies in one of its ranges (within ``slack``), brought to [-1, 1].

    ``axes``: value and ranges; an axis without ranges doesn't count, one of unknown value counts as not satisfied.
    """
    n, met = F.lit(0), F.lit(0)
    for value, ranges in axes.values():
        required = F.coalesce(F.size(ranges), F.lit(0)) > 0
        ok = F.coalesce(F.exists(ranges, lambda r: (value >= r["lo"] - slack) & (value <= r["hi"] + slack)), F.lit(False))
        n, met = n + required.cast("int"), met + (required & ok).cast("int")
    return F.when(n == 0, 0.0).otherwise(2 * met / n - 1)


def rule_mask(rules: list[tuple[str, float, Column]]) -> Column:
    """A number with a bit for each rule that holds, the first rule the lowest."""
    return sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, (_, _, c) in enumerate(rules)), F.lit(0))


def decoded_mask(mask: Column, rules: list[tuple[str, float, Column]]) -> dict[str, Column]:
    """total, plus and minus of a rule mask, as score_rules gives them."""
    return _scores([(name, weight, mask.bitwiseAND(1 << i) != 0) for i, (name, weight, _) in enumerate(rules)])


def _scores(rules: list[tuple[str, float, Column]]) -> dict[str, Column]:
    ordered = sorted(rules, key=lambda r: (-abs(r[1]), r[0]))
    holds = {name: F.coalesce(condition, F.lit(False)) for name, _, condition in ordered}
    total = sum((F.when(holds[name], weight).otherwise(0.0) for name, weight, _ in ordered), F.lit(0.0))
    ids = lambda sign: F.filter(F.array(*[F.when(holds[name], F.lit(name)) for name, weight, _ in ordered if weight * sign > 0]), lambda x: x.isNotNull())
    return {"total": total, "plus": ids(1), "minus": ids(-1)}


def score_rules(pairs: DataFrame, rules: list[tuple[str, float, Column]]) -> DataFrame:
    """``pairs`` with total, plus and minus: the sum of the weights of the rules that hold, and their ids by sign.

    Ids are ordered by falling absolute weight, then id.
    """
    return pairs.withColumns(_scores(rules))


def first_rule(df: DataFrame, key: str, rules: DataFrame, exact: list[str], least: dict[str, str]) -> DataFrame:
    """``key`` and the first rule (smallest ord) that holds: null conditions hold for anything.

    ``exact``: columns that have to be equal; ``least``: value column and the rule's lower bound. Rules are few: they
    are sent to every task, ValueError beyond MOST_RULES.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    condition = F.lit(True)
    for c in exact:
        condition = condition & (F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"d.{c}")))
    for value, bound in least.items():
        condition = condition & (F.col(f"r.{bound}").isNull() | F.coalesce(F.col(f"d.{value}") >= F.col(f"r.{bound}"), F.lit(False)))
    met = df.alias("d").join(F.broadcast(rules.alias("r")), condition, "left")
    return met.groupBy(F.col(f"d.{key}").alias(key)).agg(F.min_by("r.rule", "r.ord").alias("rule"))


def fit_score(total: Column, cap: float = 0.96) -> Column:
    """A pair's score: the logistic function of total / 5, at most ``cap``."""
    return F.least(1 / (1 + F.exp(-total / 5)), F.lit(cap))


def verdict(score: Column, worst: Column, n_rules: Column, hedged: Column, hard: float = -3.0, least: float = 0.55) -> Column:
    """neutral without rules; no for a hard conflict or too low a score; caveat if hedged; else yes."""
    return F.when(n_rules == 0, "neutral").when(F.coalesce(worst <= hard, F.lit(False)) | (score < least), "no").when(hedged, "caveat").otherwise("yes")


def layered_rules(base: DataFrame, overrides: DataFrame, patches: DataFrame, disabled: list[str], added: DataFrame) -> DataFrame:
    """(id, weight, text): base rules less the disabled, replaced by overrides, other overrides added, patched, new ones added.

    All have (id, weight, text); a patch's null leaves a field. A new rule with a taken id is an error when it is read.
    """
    kept = base.where(~F.col("id").isin(disabled)).alias("b").join(overrides.alias("o"), "id", "full_outer")
    merged = kept.select("id", F.coalesce("o.weight", "b.weight").alias("weight"), F.coalesce("o.text", "b.text").alias("text"))
    patched = merged.alias("m").join(patches.alias("p"), "id", "left").select("id", F.coalesce("p.weight", "m.weight").alias("weight"), F.coalesce("p.text", "m.text").alias("text"))
    together = patched.unionByName(added.select("id", "weight", "text"))
    n = F.count("*").over(Window.partitionBy("id"))
    return together.withColumn("__n", n).withColumn("id", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("rule twice: "), "id"))).otherwise(F.col("id"))).drop("__n")
