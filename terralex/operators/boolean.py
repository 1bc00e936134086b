"""Boolean queries over the index: AND, OR, NOT and parentheses, compiled to one aggregation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binding strengths: NOT before AND before OR.
STRENGTH = {"NOT": 3, "AND": 2, "OR": 1}


def postfix(expression: str) -> list[str]:
    """An expression's words and operators in postfix order; neighbouring words are joined by AND."""
    items: list[str] = []
    for token in re.findall(r"[()]|[^\s()]+", expression):
        if items and token not in ("AND", "OR", ")") and items[-1] not in ("AND", "OR", "NOT", "("):
            items.append("AND")
        items.append(token)
    out: list[str] = []
    held: list[str] = []
    for item in items:
        if item == "(":
            held.append(item)
        elif item == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("a parenthesis closes that wasn't opened")
            held.pop()
        elif item in STRENGTH:
            while item != "NOT" and held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[item]:
                out.append(held.pop())
            held.append(item)
        else:
            out.append(item.lower())
    if "(" in held:
        raise ValueError("a parenthesis isn't closed")
    return out + held[::-1]


def condition(expression: str, has: dict[str, Column] | None = None) -> tuple[Column, list[str]]:
    """The expression over columns that tell whether a term is there, and its terms."""
    terms = sorted({t for t in postfix(expression) if t not in STRENGTH})
    columns = has or {t: F.col(f"`has {t}`") for t in terms}
    stack: list[Column] = []
    for item in postfix(expression):
        try:
            if item == "NOT":
                stack.append(~stack.pop())
            elif item in STRENGTH:
                b, a = stack.pop(), stack.pop()
                stack.append(a & b if item == "AND" else a | b)
            else:
                stack.append(columns[item])
        except IndexError:
            raise ValueError("an operator lacks an operand") from None
    if len(stack) != 1:
        raise ValueError("the expression is empty")
    return stack[0], terms


def matches(docs: DataFrame, postings: DataFrame, expression: str, field: str | None = None) -> DataFrame:
    """(doc_id) of documents for which the expression holds. Only postings of its terms are read; documents without any count for NOT."""
    holds, terms = condition(expression)
    rows = postings.where(F.col("term").isin(terms))
    rows = rows if field is None else rows.where(F.col("field") == field)
    has = rows.groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f"has {t}") for t in terms))
    empty = condition(expression, {t: F.lit(False) for t in terms})[0]
    if docs.sparkSession.range(1).select(empty.alias("x")).first()[0]:  # documents without any of the terms match, too
        return docs.select("doc_id").join(has, "doc_id", "left").na.fill(False).where(holds).select("doc_id")
    return has.where(holds).select("doc_id")


def intersection(postings: DataFrame, terms: list[str], field: str) -> DataFrame:
    """(doc_id, tf): documents with all terms in a field, and how often the least frequent one occurs."""
    wanted = sorted(set(terms))
    rows = postings.where((F.col("field") == field) & F.col("term").isin(wanted))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).where(F.col("n") == len(wanted)).select("doc_id", "tf")


def union(postings: list[DataFrame]) -> DataFrame:
    """Multiset union of posting lists (doc_id, tf)."""
    return reduce(DataFrame.unionByName, postings).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
