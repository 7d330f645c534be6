"""The read surface: filter, select, expand, orderby, top, skip and count as text, over a catalogue of tables.

A filter is rewritten token by token to a Spark SQL expression, which Spark parses and analyses: precedence, nesting and the types of
functions are Spark's own. What is added is what SQL lacks: positions in errors, literals checked against their column, associations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import parse_qsl

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an expanded many-side that a row takes along, unless the request says otherwise.
EXPANDED_ROWS = 100


@dataclass(frozen=True)
class Association:
    """To another table by equal columns (own to theirs); `many` rows of it, or one."""

    table: str
    on: dict = field(hash=False)
    many: bool = False


_ORDER, _LINE = {"po_number": "po_number"}, {"po_number": "po_number", "line_item": "line_item"}
_DELIVERIES = Association("asn_ibd", {"po_number": "reference_document", "line_item": "reference_item"}, True)
#: The associations of each table by name.
ASSOCIATIONS = {
    "po_lines": {
        "material": Association("materials", {"material_id": "material"}), "supplier": Association("suppliers", {"supplier_id": "supplier"}), "plant_ref": Association("plants", {"plant": "plant_code"}),
        "asns": _DELIVERIES, "po_partners": Association("po_partners", _ORDER, True), "carrier_events": Association("carrier_events", _ORDER, True),
    },
    "exceptions": {"po_line": Association("po_lines", _LINE), "asns": _DELIVERIES, "carrier_events": Association("carrier_events", _ORDER, True)},
    "idoc_errors": {"po_line": Association("po_lines", _LINE)},
    "feedback": {"exception": Association("exceptions", {"exception_id": "exception_id"})},
}


class RequestError(ValueError):
    """A request that can't be read; position counts characters of its text from 0."""

    def __init__(self, what: str, position: int | None = None):
        super().__init__(what if position is None else f"{what} at position {position}")
        self.position = position


_TOKEN = re.compile(
    r"(?P<typed>(?:datetimeoffset|datetime|date)'[^']*')|(?P<string>'(?:[^']|'')*')|(?P<time>\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?)"
    r"|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[mMdDlLfF]?)(?![\w.])|(?P<word>[A-Za-z_]\w*(?:/[A-Za-z_]\w*)*)|(?P<mark>[(),])"
)
_COMPARED = {"eq": "is not distinct from", "ne": "is distinct from", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_JOINED = {"and": "and", "or": "or"}
#: Name in a request: what stands for `name(`. A substring's place counts from 0, so it gets one more behind its comma.
_FUNCTIONS = {
    "contains": "contains(", "startswith": "startswith(", "endswith": "endswith(", "substringof": "0 < locate(", "tolower": "lower(", "toupper": "upper(", "trim": "trim(", "length": "length(", "indexof": "-1 + instr(",
    "substring": "substring(", "concat": "concat(", "year": "year(", "month": "month(", "day": "day(", "hour": "hour(", "minute": "minute(", "second": "second(", "round": "round(", "floor": "floor(", "ceiling": "ceil(", "date": "to_date(",
}
_NUMERIC = re.compile(r"tinyint|smallint|int|bigint|float|double|decimal")


@dataclass
class _Token:
    kind: str
    text: str
    at: int


def _tokens(text: str) -> list[_Token]:
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise RequestError(f"unexpected {text[at]!r}", at)
        out.append(_Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(token: _Token, kind: str | None) -> str:
    """A literal as SQL, of the type of the column that it is held against, where there is one."""
    text = token.text
    if token.kind == "word":  # null, true, false
        if text == "null" or kind in (None, "boolean"):
            return text
        raise RequestError(f"{text} isn't a {kind}", token.at)
    value = text[text.index("'") + 1 : -1].replace("''", "'") if token.kind in ("string", "typed") else text
    moment = token.kind in ("typed", "time")
    wrong = (
        kind is not None and (_NUMERIC.match(kind) and token.kind != "number" or kind == "boolean" or kind == "string" and token.kind != "string" or kind in ("timestamp", "date") and token.kind == "number")
    )
    if wrong:
        raise RequestError(f"{text} isn't a {kind}", token.at)
    if moment or kind in ("timestamp", "date"):
        try:
            datetime.fromisoformat(value)
        except ValueError:
            raise RequestError(f"{text} isn't a time", token.at) from None
        return f"cast({_quoted(value)} as {kind or 'timestamp'})"
    if token.kind == "number":
        number = text.rstrip("mMdDlLfF")
        return f"cast({number} as {kind})" if kind in ("float", "double") else number
    return _quoted(value)


def filter_sql(text: str, kinds: dict[str, str], now: str | None = None) -> str:
    """The Spark SQL of a filter over columns by type; `association/column` is a column too. now stands for now()."""
    tokens, out, open_, at = _tokens(text), [], [], 0
    column = lambda i: kinds.get(tokens[i].text) if 0 <= i < len(tokens) and tokens[i].kind == "word" else None
    is_word = lambda i, words: 0 <= i < len(tokens) and tokens[i].kind == "word" and tokens[i].text in words
    opens = lambda i: i < len(tokens) and tokens[i].text == "("
    while at < len(tokens):
        t, known = tokens[at], tokens[at].text in kinds
        if t.kind == "mark":
            if t.text == "(":
                open_.append(("(", column(at - 2) if is_word(at - 1, ("in",)) else None, t.at))
            elif not open_:
                raise RequestError(f"unexpected {t.text!r}", t.at)
            elif t.text == ")":
                open_.pop()
            out.append(", 1 +" if t.text == "," and open_ and open_[-1][0] == "substring" else t.text)
            if t.text == "," and open_ and open_[-1][0] == "substring":
                open_[-1] = ("(", None, open_[-1][2])
        elif t.kind == "word" and t.text == "now" and opens(at + 1):
            if now is None or at + 2 >= len(tokens) or tokens[at + 2].text != ")":
                raise RequestError("now() can't be used here", t.at)
            out.append(f"cast({_quoted(now)} as timestamp)")
            at += 2
        elif t.kind == "word" and t.text in _FUNCTIONS and opens(at + 1):
            out.append(_FUNCTIONS[t.text])
            open_.append((t.text, None, t.at))
            at += 1
        elif known and not opens(at + 1):
            out.append(".".join(f"`{part}`" for part in t.text.split("/")))
        elif is_word(at, _COMPARED) or is_word(at, _JOINED) or is_word(at, ("in",)):
            out.append(_COMPARED.get(t.text) or _JOINED.get(t.text) or "in")
        elif is_word(at, ("not",)):
            if column(at + 1) is not None:  # binds more closely than a comparison
                out.append(f"(not `{tokens[at + 1].text}`)")
                at += 1
            else:
                out.append("not")
        elif t.kind != "word" or t.text in ("null", "true", "false"):
            kind = column(at - 2) if is_word(at - 1, _COMPARED) else column(at + 2) if is_word(at + 1, _COMPARED) else open_[-1][1] if open_ and open_[-1][0] == "(" else None
            out.append(_literal(t, kind))
        else:
            raise RequestError(f"unknown {'function' if opens(at + 1) else 'column'} {t.text}", t.at)
        at += 1
    if open_:
        raise RequestError("a parenthesis isn't closed", open_[-1][2])
    return " ".join(out)


def _parts(text: str, mark: str) -> list[str]:
    """Pieces between marks that stand in no parentheses and no string."""
    out, depth, quoted, start = [], 0, False, 0
    for i, x in enumerate(text):
        quoted ^= x == "'"
        depth += (x == "(") - (x == ")") if not quoted else 0
        if x == mark and not depth and not quoted:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


def _columns(names: list[str], df: DataFrame) -> list[str]:
    for name in names:
        if name not in df.columns:
            raise RequestError(f"unknown column {name}")
    return names


def _number(options: dict, name: str, default: int | None) -> int | None:
    if name not in options:
        return default
    if not options[name].isdigit():
        raise RequestError(f"{name} isn't a number: {options[name]}")
    return int(options[name])


def _order(text: str | None, kinds: dict[str, str]) -> list[Column]:
    out = []
    for part in _parts(text or "", ","):
        name, _, way = part.partition(" ")
        if name not in kinds or way.strip().lower() not in ("", "asc", "desc"):
            raise RequestError(f"can't order by {part}")
        c = F.col(".".join(f"`{x}`" for x in name.split("/")))
        out.append(c.desc_nulls_last() if way.strip().lower() == "desc" else c.asc_nulls_first())
    return out


def _kinds(df: DataFrame) -> dict[str, str]:
    """Type by column, those of associated rows as `association/column`."""
    out = dict(df.dtypes)
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out |= {f"{f.name}/{x.name}": x.dataType.simpleString() for x in f.dataType}
    return out


def _matching(df: DataFrame, text: str | None, now: str | None) -> DataFrame:
    if not text:
        return df
    sql = filter_sql(text, _kinds(df), now)
    try:
        return df.filter(F.expr(sql))
    except (ParseException, AnalysisException) as e:
        raise RequestError(f"can't read the filter: {str(e).splitlines()[0]}") from None


def _with_one(catalogue, df: DataFrame, name: str, a: Association) -> DataFrame:
    """df with the associated row as a struct; the other table has one row a key."""
    other = getattr(catalogue, a.table)
    row = F.struct(*[F.col(c) for c in other.columns]).alias(name)
    keyed = other.select(*[F.col(theirs).alias(f"key_{ours}") for ours, theirs in a.on.items()], row)
    test = [F.col(ours) == F.col(f"key_{ours}") for ours in a.on]
    return df.join(keyed, test, "left").drop(*[f"key_{ours}" for ours in a.on])


def _with_many(catalogue, df: DataFrame, name: str, a: Association, options: dict, now: str | None) -> DataFrame:
    """df with an array of the associated rows, the first ones by the request's order, or by all columns."""
    other = _matching(getattr(catalogue, a.table), options.get("$filter"), now)
    kept = _columns(_parts(options.get("$select", ""), ","), other) or other.columns
    keys = [F.col(theirs) for theirs in a.on.values()]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(options.get("$orderby"), _kinds(other)), *other.columns))
    rows = other.withColumn("place_", place).filter(F.col("place_") <= _number(options, "$top", EXPANDED_ROWS))
    packed = rows.groupBy(*[k.alias(f"key_{ours}") for k, ours in zip(keys, a.on, strict=True)]).agg(F.array_sort(F.collect_list(F.struct("place_", F.struct(*kept).alias("row")))).alias("rows_"))
    packed = packed.select(*[f"key_{ours}" for ours in a.on], F.transform("rows_", lambda x: x["row"]).alias(name))
    joined = df.join(packed, [F.col(ours) == F.col(f"key_{ours}") for ours in a.on], "left").drop(*[f"key_{ours}" for ours in a.on])
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def _options(text: str) -> dict[str, str]:
    out = {}
    for part in _parts(text, ";"):
        name, equals, value = part.partition("=")
        if not equals or name.strip() not in ("$filter", "$select", "$orderby", "$top"):
            raise RequestError(f"can't read {part}")
        out[name.strip()] = value.strip()
    return out


def request(catalogue, text: str, now: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows, one row with total where $count=true, else None) of `table?$filter=...&$select=...&$expand=...&$orderby=...&$top=...&$skip=...`.

    eq and ne take null for a value like others; the other comparisons with null are unknown, as in SQL. $top=0 gives no rows. What
    can't be read is a RequestError: an unknown table, column, function or option, a literal that isn't of its column's type, a text
    that isn't an expression.
    """
    table, _, query = text.partition("?")
    options = dict(parse_qsl(query, keep_blank_values=True))
    if unknown := set(options) - {"$filter", "$select", "$expand", "$orderby", "$top", "$skip", "$count"}:
        raise RequestError(f"unknown option {', '.join(sorted(unknown))}")
    if not table.isidentifier() or table.startswith("_"):
        raise RequestError(f"unknown table {table}")
    try:
        df, known = getattr(catalogue, table), ASSOCIATIONS.get(table, {})
    except (AttributeError, AnalysisException):
        raise RequestError(f"unknown table {table}") from None
    own, expands = df.columns, {}
    for part in _parts(options.get("$expand", ""), ","):
        name, _, inner = part.partition("(")
        if name not in known:
            raise RequestError(f"unknown association {name}")
        expands[name] = _options(inner.removesuffix(")"))
    paths = {name for name, a in known.items() if not a.many and (name in expands or re.search(rf"\b{name}/", options.get("$filter", "") + options.get("$orderby", "")))}
    for name in sorted(paths):
        df = _with_one(catalogue, df, name, known[name])
    df = _matching(df, options.get("$filter"), now)
    total = df.agg(F.count("*").alias("total")) if options.get("$count") == "true" else None
    order = _order(options.get("$orderby"), _kinds(df))
    top, skip = _number(options, "$top", None), _number(options, "$skip", 0)
    if order or top is not None or skip:
        df = df.orderBy(*order, *own)  # pages need an order of all rows
    df = df.offset(skip) if skip else df
    df = df.limit(top) if top is not None else df
    shown = _columns(_parts(options.get("$select", ""), ","), df.select(*own)) or own
    extra = []
    for name, inner in expands.items():
        if known[name].many:
            df = _with_many(catalogue, df, name, known[name], inner, now)
            extra.append(F.col(name))
        else:
            chosen = _parts(inner.get("$select", ""), ",")
            there = [x.name for x in df.schema[name].dataType]
            if missing := [x for x in chosen if x not in there]:
                raise RequestError(f"unknown column {name}/{missing[0]}")
            extra.append(F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{x}") for x in chosen])).alias(name) if chosen else F.col(name))
    if (order or top is not None or skip) and any(known[name].many for name in expands):
        df = df.orderBy(*order, *own)  # the joins have mixed the page
    return df.select(*shown, *extra), total
