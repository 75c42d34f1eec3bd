"""A read-only SQL surface: one SELECT over the views that a caller is given, with a limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 200
# Words that no statement may hold, wherever they stand.
WRITING = "insert update delete drop alter create truncate grant revoke comment vacuum call execute copy commit rollback".split()
# The functions that a statement may call.
FUNCTIONS = frozenset(
    "abs acos any_value approx_count_distinct array array_agg array_contains asin atan avg bool_and bool_or cardinality case cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop covar_samp "
    "cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp explode extract first first_value floor format_number format_string "
    "greatest grouping grouping_id hour if ifnull initcap instr isnan isnull isnotnull lag last last_day last_value lcase lead least left length ln log log10 log2 lower lpad ltrim max max_by mean median min min_by minute mod month months_between named_struct negative "
    "nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pi position positive pow power quarter radians rank regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim second sequence sign sin size "
    "some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring sum tan to_date to_timestamp trim try_cast try_divide typeof ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket window year".split()
)
# The nodes of a parsed statement that only read given tables.
NODES = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin Union Distinct Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedHaving OneRowRelation WithWindowDefinition Sample Generate Pivot Unpivot".split())
# What the parser leaves unresolved in expressions and is no way around a name.
UNRESOLVED = frozenset("UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedExtractValue UnresolvedOrdinal UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedInlineTable UnresolvedWindowExpression".split())
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery".split())
#: Text that names nothing: strings, quoted names and comments.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


class NotAllowed(ValueError):
    pass


def looks_like_sql(question: str) -> bool:
    """Whether a question is a statement already."""
    return bool(re.match(r"(?i)\s*select\b", question))


def _each(seq):
    """The members of a Scala sequence."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class Guard:
    """Walks a parsed statement node by node: plans, expressions and subqueries of a kind that is listed, functions and relations by name. Whatever isn't listed is refused."""

    def __init__(self, tables, schemas: tuple[str, ...] | None, with_clauses: bool):
        self.tables, self.schemas, self.with_clauses = {t.lower() for t in tables}, schemas, with_clauses

    def plan(self, node, own: frozenset[str] = frozenset()) -> None:
        name = node.getClass().getSimpleName()
        if name == "UnresolvedWith" and self.with_clauses:
            for part in _each(node.cteRelations()):
                self.plan(part._2(), own)
                own = own | {part._1().lower()}
            self.plan(node.child(), own)
            return
        if name not in NODES:
            raise NotAllowed(f"{name} isn't allowed: only SELECT is")
        if name == "UnresolvedRelation":
            self.relation([str(x) for x in _each(node.multipartIdentifier())], own)
        for e in _each(node.expressions()):
            self.expression(e, own)
        for child in _each(node.children()):
            self.plan(child, own)

    def relation(self, parts: list[str], own: frozenset[str]) -> None:
        if len(parts) > 1 and (len(parts) > 2 or self.schemas is None or parts[0].lower() not in self.schemas):
            raise NotAllowed(f"the schema {parts[0]} isn't allowed")
        if parts[-1].lower() not in (self.tables | own if len(parts) == 1 else self.tables):
            raise NotAllowed(f"no table {'.'.join(parts)}")

    def expression(self, e, own: frozenset[str]) -> None:
        kind, name = e.getClass().getName(), e.getClass().getSimpleName()
        if not kind.startswith("org.apache.spark.sql.catalyst.expressions.") and name not in UNRESOLVED:
            raise NotAllowed(f"{name} isn't allowed")
        if name == "UnresolvedFunction":
            self.function(e.nameParts().mkString("."))
        elif name == "UnresolvedGenerator":
            self.function(e.name().unquotedString())
        elif name in SUBQUERIES:
            self.plan(e.plan(), own)
        elif "Reflect" in name or "InputFile" in name or name.startswith("Python"):
            raise NotAllowed(f"{name} isn't allowed")
        for child in _each(e.children()):
            self.expression(child, own)

    def function(self, name: str) -> None:
        if name.lower() not in FUNCTIONS:
            raise NotAllowed(f"the function {name} isn't allowed")


class SqlTool:
    """Queries see the given tables alone. Spark parses the statement, and Guard walks its plan: only nodes that read, only relations that are given, only functions that are listed.

    with_clauses lets WITH through, which a plain tool refuses. Words in strings, quoted names and comments are not looked at.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], max_rows: int = MAX_ROWS, with_clauses: bool = False, schemas: tuple[str, ...] | None = None):
        self.spark, self.max_rows, self.with_clauses, self.schemas = spark, max_rows, with_clauses, schemas
        self.tables = tables

    def checked(self, statement: str) -> str:
        bare = _QUOTED.sub(lambda m: " " if m[0][0] in "-/" else " '' ", statement).strip()
        if not re.match(r"(?i)(select|with)\b" if self.with_clauses else r"(?i)select\b", bare):
            raise NotAllowed("only SELECT is allowed")
        if ";" in bare.rstrip("; \t\r\n"):
            raise NotAllowed("one statement at a time")
        if re.search(rf"(?i)\b({'|'.join(WRITING)})\b", bare):
            raise NotAllowed("a word that isn't allowed")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        except Exception as e:
            raise NotAllowed(f"not one statement that can be parsed: {e}") from None
        Guard(self.tables, self.schemas, self.with_clauses).plan(plan)
        return statement

    def select(self, statement: str) -> DataFrame:
        """The whole result of a statement that has been checked."""
        text = self.checked(statement)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def run(self, statement: str, limit: int | None = None) -> DataFrame:
        """At most limit rows, and never more than max_rows."""
        return self.select(statement).limit(min(limit or self.max_rows, self.max_rows))

    def simple(self, statement: str) -> DataFrame:
        """SELECT columns FROM table [WHERE column = 'value'], where columns that the table lacks are null. Any other WHERE is an error."""
        m = re.fullmatch(r"(?is)\s*select\s+([\w*,\s]+?)\s+from\s+([\w-]+)(?:\s+where\s+([\w-]+)\s*=\s*'([^']*)')?\s*;?\s*", statement)
        if not m or m[2] not in self.tables:
            raise NotAllowed("not a simple SELECT over a known table")
        df = self.tables[m[2]]
        if m[3]:
            df = df.where((F.col(m[3]) if m[3] in df.columns else F.lit(None)).cast("string") == m[4])
        names = [c.strip() for c in m[1].split(",")]
        return df.select(*[x for n in names for x in (df.columns if n == "*" else [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n)])]).limit(self.max_rows)

    def columns(self) -> DataFrame:
        rows = [(t, f.name, f.dataType.simpleString(), f.nullable, i) for t, df in sorted(self.tables.items()) for i, f in enumerate(df.schema.fields, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, position int")


class NoSql:
    """The surface where SQL is switched off."""

    def run(self, statement: str, limit: int | None = None) -> DataFrame:
        raise NotAllowed("SQL is switched off")

    select = simple = run
