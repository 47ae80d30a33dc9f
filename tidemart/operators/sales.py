"""Order lines joined with their orders and with the latest user values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions.columns import age_in_years, number
from tidemart.schemas import JOIN_BOUND_SECONDS, SALE_DETAIL

_ORDER_SIDE = ["order_id", "order_status", "create_time", "user_id", "dt"]
_DETAIL_SIDE = ["order_detail_id", "sku_id", "sku_price", "sku_name"]
USER_VALUES = ("user_gender", "user_level", "_birthday")
_USER_SIDE = ["user_gender", "user_age", "user_level", "age_known"]


def order_side(orders: DataFrame, *extra: str) -> DataFrame:
    """The few order columns a sale detail needs, so no others are shuffled."""
    return orders.where(F.col("id").isNotNull()).select(
        F.col("id").alias("order_id"), "order_status", "create_time", "user_id",
        F.col("create_date").alias("dt"), *extra)


def detail_side(details: DataFrame, *extra: str) -> DataFrame:
    return details.where(F.col("order_id").isNotNull()).select(
        "order_id", F.col("id").alias("order_detail_id"), "sku_id",
        number(F.col("order_price")).alias("sku_price"), "sku_name", *extra)


def join_lines(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Sale details of the lines whose order is present."""
    return (detail_side(details).join(order_side(orders), "order_id")
            .select(*_ORDER_SIDE, *_DETAIL_SIDE))


def full_outer_lines(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Every order and every line, matched on the order id where possible.

    ``side`` tells which of the two was there. Written as lines LEFT JOIN
    orders plus the orders without a line: Spark can split a skewed left side
    of an outer join at run time, which it cannot do for a full outer join, so
    an order id that holds a third of the lines does not end up in one task.
    The second part sees each order id of the lines once per map task.
    """
    lines, heads = detail_side(details), order_side(orders)
    side = F.when(F.col("o.order_id").isNotNull(), "both").otherwise("detail_only")
    matched = (lines.alias("d").join(heads.alias("o"),
                                     F.col("d.order_id") == F.col("o.order_id"), "left")
               .select("d.*", *[f"o.{c}" for c in _ORDER_SIDE if c != "order_id"],
                       side.alias("side")))
    ids = lines.select("order_id").distinct()
    alone = heads.join(ids, "order_id", "left_anti").withColumn("side", F.lit("order_only"))
    columns = [*_ORDER_SIDE, *_DETAIL_SIDE, "side"]
    return (matched.select(*columns)
            .unionByName(alone, allowMissingColumns=True).select(*columns))


def within(left: Column, right: Column, seconds: int = JOIN_BOUND_SECONDS) -> Column:
    """``right`` lies at most ``seconds`` before or after ``left``."""
    bound = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return right.between(left - bound, left + bound)


def interval_join(orders: DataFrame, details: DataFrame,
                  seconds: int = JOIN_BOUND_SECONDS, salts: int = 1,
                  extra: Sequence[str] = (), fresh: str | None = None) -> DataFrame:
    """Lines and orders of the same id received within ``seconds`` of each other.

    Both sides carry their receive time ``rt``; the bound is inclusive and
    every matching pair appears once. Works on batch and on watermarked
    streaming inputs. ``salts`` > 1 spreads the lines of one order over that
    many tasks and repeats each order as often: for streams, where no run-time
    skew handling exists. ``extra`` columns of the orders are kept. With ``fresh``,
    a flag that both sides carry, only pairs with a fresh row on either side count.
    """
    flag = [fresh] if fresh else []
    heads = order_side(orders, F.col("rt").alias("order_rt"), *extra, *flag)
    lines = detail_side(details, F.col("rt").alias("detail_rt"), *flag)
    keys = F.col("o.order_id") == F.col("d.order_id")
    if salts > 1:
        every = F.array(*[F.lit(i) for i in range(salts)])
        heads = heads.withColumn("salt", F.explode(every))
        lines = lines.withColumn(
            "salt", F.pmod(F.xxhash64("order_detail_id"), F.lit(salts)).cast("int"))
        keys = keys & (F.col("o.salt") == F.col("d.salt"))
    if fresh:
        keys = keys & (F.col(f"o.{fresh}") | F.col(f"d.{fresh}"))
    pairs = heads.alias("o").join(
        lines.alias("d"),
        keys & within(F.col("o.order_rt"), F.col("d.detail_rt"), seconds))
    return pairs.select(*[F.col(f"o.{c}").alias(c) for c in _ORDER_SIDE],
                        *[F.col(f"d.{c}").alias(c) for c in _DETAIL_SIDE],
                        *[F.col(f"o.{c}").alias(c) for c in extra],
                        F.greatest("o.order_rt", "d.detail_rt").alias("joined_rt"))


def user_side(users: DataFrame) -> DataFrame:
    return users.where(F.col("id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("gender").alias("user_gender"),
        F.col("user_level"), F.col("birthday").alias("_birthday"))


def add_user(rows: DataFrame, users: DataFrame, as_of: Column | str) -> DataFrame:
    """Add gender, age and level of the latest user row (one per id).

    An unknown user keeps the row: gender and level stay NULL and the age
    defaults to 0, with ``age_known`` false.
    """
    return with_age(with_user(rows, users), as_of)


def with_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The columns :data:`USER_VALUES` of the user row, for :func:`with_age`."""
    return rows.join(user_side(users), "user_id", "left")


def with_age(rows: DataFrame, as_of: Column | str) -> DataFrame:
    age = age_in_years(F.col("_birthday"), as_of)
    return (rows.withColumns({"age_known": age.isNotNull(), "user_age": F.coalesce(age, F.lit(0))})
            .drop("_birthday"))


def enriched_sale_details(orders: DataFrame, details: DataFrame, users: DataFrame,
                          as_of: Column | str) -> DataFrame:
    """Sale details with user values.

    The user join happens on the orders: they are the smaller side, so the
    order lines are shuffled once (by order id) instead of twice.
    """
    heads = add_user(order_side(orders), users, as_of)
    return (detail_side(details).join(heads, "order_id")
            .select(*SALE_DETAIL.fieldNames()))


def users_of(sales: DataFrame, users: DataFrame) -> DataFrame:
    """Only the user rows some sale refers to.

    For the orders of a micro-batch against the whole dimension: the few ids of the batch
    cut the dimension down before anything of it is shuffled or ranked.
    """
    wanted = sales.select(F.col("user_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return users.join(wanted, "id", "left_semi")


def enrich(sales: DataFrame, users: DataFrame, as_of: Column | str) -> DataFrame:
    """User values for finished sale details."""
    return finished(with_user(sales, users), as_of)


def finished(sales: DataFrame, as_of: Column | str) -> DataFrame:
    """Sale details of a streaming join whose orders had their :func:`with_user`."""
    kept = [c for c in sales.columns if c not in SALE_DETAIL.fieldNames() and c not in USER_VALUES]
    return with_age(sales, as_of).select(*SALE_DETAIL.fieldNames(), *kept)
