"""Reading a published ledger: curated views, bounded answers and display texts."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import policies as P


class AnswerError(ValueError):
    """The question is outside the read boundary, or its answer is too large."""


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[tuple]
    coverage: dict


# Spark's names for what the curated functions do, beyond the list in the policies.
_SPARK_FUNCTIONS = {
    "ilike", "like", "between", "in", "not", "and", "or", "to_date", "date_add", "date_sub", "datediff",
    "date_format", "trunc", "year", "month", "quarter", "greatest", "least", "div",
}
_FUNCTIONS = set(P.CURATED_FUNCTIONS) | _SPARK_FUNCTIONS
_PLANS = {
    "Project", "Filter", "UnresolvedHaving", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Join",
    "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith",
    "UnresolvedRelation", "OneRowRelation", "WithWindowDefinition",
}
_EXPRESSIONS = {
    "Literal", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "Alias", "UnresolvedFunction", "EqualTo",
    "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Not", "And", "Or", "In",
    "InSubquery", "ListQuery", "ScalarSubquery", "Exists", "IsNull", "IsNotNull", "Like", "ILike", "Between", "Add",
    "Subtract", "Multiply", "Divide", "Remainder", "IntegralDivide", "UnaryMinus", "UnaryPositive", "CaseWhen", "Cast",
    "SortOrder", "WindowExpression", "WindowSpecDefinition", "UnresolvedWindowExpression", "SpecifiedWindowFrame",
    "UnspecifiedFrame$", "CurrentRow$", "UnboundedPreceding$", "UnboundedFollowing$", "UnresolvedOrdinal", "Concat",
}
# Names that read the session although they look like columns.
_SESSION_NAMES = {
    "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema",
    "current_date", "current_timestamp", "localtimestamp", "current_time", "current_timezone",
}
_VIEWS = {"invoices", "accounts"}


def isolated_session(spark: SparkSession, tables: dict[str, str]) -> SparkSession:
    """A session that sees the given Parquet folders as views, with only their curated columns.

    Temporary views of the caller are not visible in it and files cannot be named in SQL.
    """
    columns = {"invoices": P.CURATED_INVOICE_COLUMNS, "accounts": P.CURATED_ACCOUNT_COLUMNS}
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, path in tables.items():
        session.read.parquet(path).select(*columns[name]).createOrReplaceTempView(name)
    session.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION julianday(d DATE) RETURNS DOUBLE "
        "RETURN datediff(d, DATE'1970-01-01') + 2440587.5"
    )
    session.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strftime(f STRING, d DATE) RETURNS STRING "
        "RETURN date_format(d, replace(replace(replace(f, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'))"
    )
    return session


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_tree(node, visible: set[str]) -> None:
    """Refuse whatever is not a query over the views and the query's own named parts.

    ``node`` is a node of the tree that Spark's parser made; nothing has been resolved or run.
    """
    kind = node.getClass().getSimpleName()
    if kind not in _PLANS:
        raise AnswerError(f"not supported in a query: {kind}")
    if kind == "UnresolvedWith":
        if "allowRecursion" in dir(node) and node.allowRecursion():
            raise AnswerError("recursive queries are not supported")
        for part in _items(node.cteRelations()):
            _check_tree(part._2(), visible)
            visible = visible | {part._1().lower()}
    if kind == "UnresolvedRelation":
        name = [str(x).lower() for x in _items(node.multipartIdentifier())]
        if len(name) != 1 or name[0] not in visible:
            raise AnswerError(f"table not available: {'.'.join(name)}")
    for expression in _items(node.expressions()):
        _check_expression(expression, visible)
    for child in _items(node.children()):
        _check_tree(child, visible)


def _check_expression(node, visible: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in _EXPRESSIONS:
        raise AnswerError(f"not supported in an expression: {kind}")
    if kind in ("UnresolvedFunction", "UnresolvedAttribute"):
        name = [str(x).lower() for x in _items(node.nameParts())]
        if kind == "UnresolvedFunction" and (len(name) != 1 or name[0] not in _FUNCTIONS):
            raise AnswerError(f"function not available: {'.'.join(name)}")
        if kind == "UnresolvedAttribute" and name[-1] in _SESSION_NAMES:
            raise AnswerError(f"column not available: {name[-1]}")
    if kind in ("ScalarSubquery", "ListQuery", "Exists"):
        _check_tree(node.plan(), visible)
    if kind == "InSubquery":
        _check_tree(node.query().plan(), visible)
    for child in _items(node.children()):
        _check_expression(child, visible)


def curated_query(session: SparkSession, sql: str) -> DataFrame:
    """A single read-only query over the curated views.

    Spark's own parser reads the text, and every node of its tree must be on a list: plans without
    commands and table functions, relations that are a view or a part named in the query, functions of
    the policies.
    """
    if not sql.strip() or len(sql) > P.MAX_SQL_CHARS:
        raise AnswerError("the query is blank or too long")
    try:
        tree = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:
        raise AnswerError(f"not a query: {str(exc).splitlines()[0]}") from None
    _check_tree(tree, _VIEWS)
    try:
        return session.sql(sql)
    except Exception as exc:
        raise AnswerError(f"not answerable: {str(exc).splitlines()[0]}") from None


def bounded_rows(df: DataFrame, max_rows: int = P.MAX_ANSWER_ROWS) -> list[tuple]:
    """All rows of a small answer; one row too many is an error, never a silent cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise AnswerError(f"the answer has over {max_rows} rows; ask for fewer")
    return [tuple(row) for row in rows]


def answer(df: DataFrame, evidence: DataFrame, max_rows: int = P.MAX_ANSWER_ROWS) -> Answer:
    return Answer(df.columns, bounded_rows(df, max_rows), evidence.head().asDict(recursive=True))


def capped(df: DataFrame, max_rows: int = P.MAX_ANSWER_ROWS) -> DataFrame:
    """The answer as a table that fails as a whole, whenever it is read, if it has a row too many.

    Spark gathers one row beyond the ceiling at most; in that one partition rows are numbered as they come, and the
    number after the last admitted one is an error.
    """
    name = "_answer_row"
    numbered = df.limit(max_rows + 1).coalesce(1).withColumn(name, F.monotonically_increasing_id())
    too_many = F.raise_error(F.lit(f"the answer has over {max_rows} rows; ask for fewer"))
    return numbered.filter(F.when(F.col(name) < max_rows, F.lit(True)).otherwise(too_many.cast("boolean"))).drop(name)


def with_coverage(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """The answer rows with the coverage fields on each, for answers that stay tables."""
    fields = evidence.select(F.struct("*")).scalar()
    return df.withColumns({f"coverage_{name}": fields[name] for name in evidence.columns})


def _grouped(number: Column) -> Column:
    """Plain number text with commas between thousands, however large or small a double is."""
    plain = number.try_cast("decimal(38,12)")
    cut = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    text = F.coalesce(cut, number.cast("string"))
    return F.when(
        F.contains(text, F.lit(".")),
        F.regexp_replace(text, r"(?<=\d)(?=(?:\d{3})+\.)", ","),
    ).otherwise(F.regexp_replace(text, r"(?<=\d)(?=(?:\d{3})+$)", ","))


def visible(text: Column) -> Column:
    """Show control characters as \\uXXXX; texts without any pass unchanged."""

    def escaped(char: Column) -> Column:
        code = F.lower(F.hex(F.ascii(char)))
        padded = F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code)
        return F.when(char.rlike(r"\p{C}"), F.concat(F.lit("\\u"), padded)).otherwise(char)

    return F.when(
        text.rlike(r"\p{C}"), F.array_join(F.transform(F.split(text, ""), escaped), "")
    ).otherwise(text)


def display(df: DataFrame) -> DataFrame:
    """Every column as text, formatted by its suffix and type; NULL reads Unknown."""
    shown = []
    for field in df.schema:
        value, name = F.col(field.name), field.name
        if isinstance(field.dataType, T.NumericType):
            if name.endswith("_usd"):
                text = F.concat(F.lit("$"), F.format_number(value, 2))
            elif name.endswith("_usd_cents"):
                text = F.concat(_grouped(value), F.lit(" cents"))
            elif name.endswith("_pct"):
                text = F.concat(F.format_number(value, 2), F.lit("%"))
            else:
                text = _grouped(value)
        else:
            text = visible(value.cast("string"))
        shown.append(F.coalesce(text, F.lit("Unknown")).alias(name))
    return df.select(*shown)


def heading(column: str) -> str:
    """Column name as a table heading."""
    special = {"usd": "USD", "mrr": "MRR", "csat": "CSAT", "id": "ID", "pct": "%"}
    return " ".join(special.get(w.lower(), w.capitalize()) for w in column.replace("_", " ").split())
