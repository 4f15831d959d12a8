"""Search requests, and the parameters that they are written as."""

from __future__ import annotations

import json
from collections.abc import Mapping as Params
from dataclasses import dataclass, field

from lodeseek.functions.types import FieldType, Mapping
from lodeseek.operators.aggregate import Statistic
from lodeseek.operators.filters import Filter, Op
from lodeseek.operators.paging import PAGE, PAGE_SIZE, page_numbers

RESERVED = {"cid", "index", "ps", "pg", "_shard", "_force", "_req", "show", "gather", "sort"}


class ParameterError(ValueError):
    pass


@dataclass
class SearchRequest:
    """terms: (field, value), each value cut by its field's analyzer, all terms AND-ed, filters AND-ed with them."""

    terms: list[tuple[str, str]] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    gather: list[str] = field(default_factory=list)
    statistics: list[Statistic] = field(default_factory=list)
    show: list[str] = field(default_factory=list)
    #: By weight, or by document id.
    sort: bool = True
    #: By this field instead.
    sort_by: str | None = None
    descending: bool = False
    page_size: int = PAGE_SIZE
    page: int = PAGE
    #: Only this shard, if given.
    shard: int | None = None


_OPS = {"eq": Op.EQ, "over": Op.OVER, "less": Op.LESS, "range": Op.RANGE, "not": Op.NOT, "prefix": Op.STR_PREFIX, "suffix": Op.STR_SUFFIX, "contains": Op.STR_CONTAINS_ALL, "any": Op.STR_EQUALS_ANY}


def _known(f: str, mapping: Mapping) -> str:
    mapping.kind(f)
    return f


def parse_body(text: str, mapping: Mapping) -> SearchRequest:
    """A request as one JSON object.

    search: [{field, query}], filters: [{field, op, value | values | start and end}], gather, show: lists of fields,
    sort: {by, descending} or false (document ids), statistics: [{op, field, gather, having, start, end, alias}],
    pageSize, pageNumber, shard. All are optional. Bad JSON, unknown operators and fields that aren't mapped are errors.
    """
    try:
        body = json.loads(text)
    except ValueError as e:
        raise ParameterError(f"no JSON: {e}") from e
    if not isinstance(body, dict):
        raise ParameterError("the body must be an object")
    size, number = page_numbers(body.get("pageSize", PAGE_SIZE), body.get("pageNumber", PAGE))
    out = SearchRequest(page_size=size, page=number, shard=body.get("shard"))
    try:
        out.terms = [(_known(x["field"], mapping), str(x["query"])) for x in body.get("search", [])]
        for x in body.get("filters", []):
            op = _OPS[x["op"]]
            values = tuple(x["values"]) if "values" in x else (x["value"],) if op >= Op.STR_PREFIX else ()
            bounds = (x["start"], x["end"]) if op == Op.RANGE else () if values else (x["value"],)
            out.filters.append(Filter(_known(x["field"], mapping), op, *bounds, values=values) if values else Filter(_known(x["field"], mapping), op, *bounds))
        out.gather, out.show = ([_known(f, mapping) for f in body.get(k, [])] for k in ("gather", "show"))
        for x in body.get("statistics", []):
            fields = [_known(x[k], mapping) if x.get(k) else None for k in ("field", "gather")]
            out.statistics.append(Statistic(x["op"], *fields, _OPS[x["having"]] if "having" in x else None, x.get("start"), x.get("end"), x.get("alias", "value")))
        sort = body.get("sort", True)
        if isinstance(sort, dict):
            out.sort_by, out.descending = _known(sort["by"], mapping), bool(sort.get("descending", False))
        else:
            out.sort = bool(sort)
    except (KeyError, TypeError) as e:
        raise ParameterError(f"the body lacks or mistakes {e}") from e
    return out


def _operands(name: str, text: str, kind: FieldType) -> list:
    parts = [p for p in text.split(",") if p]
    if kind == FieldType.NUMBER:
        try:
            found = [int(p, 0) if p.lower().startswith(("0x", "0b", "0o")) else int(p) for p in parts]
        except ValueError as e:
            raise ParameterError(f"{name}: {e}") from e
    else:
        found = parts
    if not found:
        raise ParameterError(f"{name} has no operand")
    return found


def parse(params: Params[str, str], mapping: Mapping) -> SearchRequest:
    """-f=a,b: any of; _f=a,b: none of; >f=a, <f=a, ~f=a,b: bounds, which belong to the range; f=text: terms.

    ps and pg give the page, show and gather name fields (comma between), sort=false turns ranking off, sort=field or
    sort=field:desc orders by a field, _force
    with _shard keeps to one shard. Operands that are no numbers, and fields that aren't mapped, are errors.
    """
    if "ps" not in params or "pg" not in params:
        raise ParameterError("ps and pg are needed")
    size, number = page_numbers(params["ps"], params["pg"])
    sort, _, direction = params.get("sort", "true").partition(":")
    out = SearchRequest(page_size=size, page=number, sort=sort.lower() != "false")
    if sort in mapping.fields:
        out.sort_by, out.descending = sort, direction.lower() == "desc"
    out.gather, out.show = ([f for f in params.get(k, "").split(",") if f] for k in ("gather", "show"))
    if params.get("_force") and "_shard" in params:
        out.shard = int(params["_shard"])
    for name, text in params.items():
        if name in RESERVED:
            continue
        mark, f = (name[0], name[1:]) if name[0] in "-_<>~" and name not in mapping.fields else ("", name)
        kind = mapping.kind(f)
        if not mark:
            out.terms.append((f, text))
            continue
        values = _operands(name, text, kind)
        if mark in "-_":
            out.filters.append(Filter(f, Op.EQ if mark == "-" else Op.NOT, values=tuple(values)))
        elif mark == "~":
            if len(values) != 2:
                raise ParameterError(f"{name} needs two bounds")
            out.filters.append(Filter(f, Op.RANGE, *values))
        else:
            out.filters.append(Filter(f, Op.OVER if mark == ">" else Op.LESS, values[0]))
    return out
