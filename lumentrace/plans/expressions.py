"""Users' SQL over one frame: Spark's parser reads it, and the plan is walked before anything is looked up or run.

Only nodes on the list are allowed, relations must be the frame or a name that the statement itself defines, and functions
must be built-in ones of the groups on the list. So paths, tables of the catalog, table functions, scripts, commands, names
that are put together at run time and functions that call other code are refused, in subqueries too.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Nodes of a parsed query that only shape rows.
NODES = set(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project RebalancePartitions
    Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith
    Unpivot WithWindowDefinition LimitAll""".split()
)
#: Groups of built-in functions that depend on their arguments alone.
GROUPS = set(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs generator_funcs hash_funcs json_funcs
    lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs""".split()
)


def _seq(items) -> Iterator:
    """The items of a Scala sequence."""
    at = items.iterator()
    while at.hasNext():
        yield at.next()


class _Walk:
    """A parsed plan's relations, functions and node names."""

    def __init__(self, spark: SparkSession, plan):
        loaded = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        of = lambda name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}", True, loaded)
        self.query, self.nested = of("plans.QueryPlan"), of("expressions.PlanExpression")
        self.nodes: set[str] = set()
        self.relations: list[tuple[str, ...]] = []
        self.functions: list[tuple[str, ...]] = []
        self.defined: set[str] = set()
        self.plan(plan)

    def plan(self, node) -> None:
        name = node.getClass().getSimpleName().rstrip("$")
        self.nodes.add(name)
        if name == "UnresolvedRelation":
            self.relations.append(tuple(_seq(node.multipartIdentifier())))
        elif name == "UnresolvedWith":
            for named in _seq(node.cteRelations()):
                self.defined.add(str(named.productElement(0)).lower())
                self.plan(named.productElement(1))
        for e in _seq(node.expressions()):
            self.expression(e)
        for child in _seq(node.children()):
            self.plan(child)

    def expression(self, e) -> None:
        name = e.getClass().getSimpleName().rstrip("$")
        if name == "UnresolvedFunction":
            self.functions.append(tuple(_seq(e.nameParts())))
        elif name == "UnresolvedGenerator":
            self.functions.append((e.name().funcName(),))
        elif "Identifier" in name:
            self.nodes.add(name)
        if self.nested.isInstance(e):
            self.plan(e.plan())
        for child in _seq(e.children()):
            (self.plan if self.query.isInstance(child) else self.expression)(child)


def checked(spark: SparkSession, sql: str, frame: str = "df") -> None:
    """ValueError unless ``sql``, in which ``{df}`` stands for the frame, is one harmless SELECT."""
    name = f"frame_{uuid.uuid4().hex}"
    try:
        text = string.Formatter().vformat(sql, (), {frame: name})
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, KeyError, IndexError, ValueError) as e:
        raise ValueError(f"only one SELECT is allowed: {e}") from e
    found = _Walk(spark, plan)
    if odd := sorted(found.nodes - NODES):
        raise ValueError(f"only a SELECT is allowed, not {', '.join(odd)}")
    if odd := sorted({".".join(r) for r in found.relations if len(r) > 1 or r[0].lower() not in found.defined | {name}}):
        raise ValueError(f"not allowed: {', '.join(odd)}")
    listed = spark._jsparkSession.sessionState().functionRegistry()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for parts in found.functions:
        info = listed.lookupFunction(identifier(parts[-1])) if len(parts) == 1 else None
        if info is None or info.isEmpty() or info.get().getSource() != "built-in" or info.get().getGroup() not in GROUPS:
            raise ValueError(f"not allowed: {'.'.join(parts)}")


def custom_sql(df: DataFrame, sql: str) -> DataFrame:
    """A SELECT over ``df``, written ``{df}``; statements and names that reach out of it are refused before Spark resolves them."""
    checked(df.sparkSession, sql)
    return df.sparkSession.sql(sql, df=df)
