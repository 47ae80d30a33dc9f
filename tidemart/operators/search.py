"""Keyword search over sale details with total, facets and paging."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.schemas import AGE_CLASSES, GENDER_CLASSES

UNKNOWN = "unknown"
PAGE_ORDER = ("dt", "order_id", "order_detail_id")


def filter_sales(sales: DataFrame, day: str | None = None, keyword: str | None = None,
                 level: str | None = None) -> DataFrame:
    """All conditions are optional; the keyword matches anywhere, in any case."""
    if day:
        sales = sales.where(F.col("dt") == day)
    if keyword:
        sales = sales.where(F.contains(F.lower("sku_name"), F.lower(F.lit(keyword))))
    if level:
        sales = sales.where(F.col("user_level") == level)
    return sales


def page_of(sales: DataFrame, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) in a total order."""
    return (sales.orderBy(*PAGE_ORDER)
            .offset((page - 1) * size).limit(size))


def cursor(page: DataFrame) -> Column:
    """The place of the last row of a page, for :func:`page_after`; NULL if it has none."""
    return page.agg(F.max(F.struct(*PAGE_ORDER)).alias("last")).scalar()


def page_after(sales: DataFrame, last: tuple[str, str, str] | Column, size: int) -> DataFrame:
    """The page behind row ``last`` (its dt, order id and detail id, or a :func:`cursor`).

    Costs the same however deep the listing is read: each task keeps ``size``
    rows, where an offset makes it keep all rows up to the page.
    """
    here = F.struct(*PAGE_ORDER)
    if isinstance(last, Column):
        return sales.where(here > last).orderBy(*PAGE_ORDER).limit(size)
    there = F.struct(*[F.lit(v).alias(n) for n, v in zip(PAGE_ORDER, last, strict=True)])
    return sales.where((F.col("dt") >= last[0]) & (here > there)).orderBy(*PAGE_ORDER).limit(size)


def hit_total(sales: DataFrame) -> DataFrame:
    return sales.agg(F.count("*").alias("total"))


def age_class():
    """Under 20, 20 to 30, over 30; a user of unknown age is a class of its own."""
    young, middle, old = AGE_CLASSES
    age = F.col("user_age")
    return (F.when(~F.col("age_known"), UNKNOWN).when(age < 20, young)
            .when(age <= 30, middle).otherwise(old))


def gender_class():
    label = F.lit(UNKNOWN)
    for code, name in GENDER_CLASSES.items():
        label = F.when(F.col("user_gender") == code, name).otherwise(label)
    return label


def facet_cells(sales: DataFrame) -> DataFrame:
    """Hits per (gender, age class): at most a dozen rows from one pass.

    The total and both facets are sums over these cells.
    """
    return (sales.groupBy(gender_class().alias("gender"), age_class().alias("age"))
            .agg(F.count("*").alias("n")))


def share_of(cells: DataFrame, by: str) -> DataFrame:
    """One facet (``gender`` or ``age``) from cells, counted here or kept by a job."""
    whole = Window.partitionBy()  # a handful of class rows
    return (cells.groupBy(F.col(by).alias("name")).agg(F.sum("n").alias("value"))
            .withColumn("share_pct", F.col("value") * F.lit(100.0)
                        / F.sum("value").over(whole)))


def gender_share(sales: DataFrame) -> DataFrame:
    return share_of(facet_cells(sales), "gender")


def age_share(sales: DataFrame) -> DataFrame:
    return share_of(facet_cells(sales), "age")


class SearchResult(NamedTuple):
    total: DataFrame
    age: DataFrame
    gender: DataFrame
    detail: DataFrame


def search(sales: DataFrame, day: str | None = None, keyword: str | None = None,
           level: str | None = None, page: int = 1, size: int = 10,
           cells: DataFrame | None = None) -> SearchResult:
    """Total, both facets and one page of the same hits.

    Total and facets share one set of cells, so the hits are read twice at
    most: once for the cells, once for the page. Kept ``cells`` of just these
    hits spare the first.
    """
    hits = filter_sales(sales, day, keyword, level)
    cells = facet_cells(hits) if cells is None else cells
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return SearchResult(total, share_of(cells, "age"), share_of(cells, "gender"),
                        page_of(hits, page, size))


def response(result: SearchResult) -> DataFrame:
    """{"total": .., "stat": [age, gender], "detail": [..]} as one JSON text.

    Only the page and the class rows enter it; the hits themselves do not.
    """
    def part(rows: DataFrame, name: str, *order: str) -> DataFrame:
        return rows.select(F.lit(name).alias("part"),
                           F.struct(F.array(*[F.col(c).cast("string") for c in order]).alias("at"),
                                    F.to_json(F.struct("*")).alias("doc")).alias("entry"))

    parts = (part(result.total, "total", "total")
             .unionByName(part(result.age, "age", "name"))
             .unionByName(part(result.gender, "gender", "name"))
             .unionByName(part(result.detail, "detail", *PAGE_ORDER)))

    def listed(name: str):
        entries = F.sort_array(F.collect_list(F.when(F.col("part") == name, F.col("entry"))))
        return F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: e["doc"]), ","),
                        F.lit("]"))

    total = F.max(F.when(F.col("part") == "total",
                         F.get_json_object("entry.doc", "$.total").cast("bigint")))
    return parts.agg(F.concat(
        F.lit('{"total":'), total.cast("string"),
        F.lit(',"stat":[{"options":'), listed("age"), F.lit('},{"options":'), listed("gender"),
        F.lit('}],"detail":'), listed("detail"), F.lit("}")).alias("value"))
