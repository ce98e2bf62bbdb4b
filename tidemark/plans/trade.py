"""Window aggregates of carts, orders, payments and refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_part, instant, money, time_of, total
from ..operators.enrich import enrich
from ..operators.state import first_of, latest_of_key, unique_and_new
from ..operators.windows import tumble


def arrivals(details: DataFrame, seconds: int = 3) -> DataFrame:
    """Order lines as an upsert stream delivers them: each twice, the second time later and dearer by one.

    ``row_op`` orders the deliveries of a line.
    """
    later = (money("split_total_amount") + 1).cast("decimal(18,2)").cast("string")
    delivery = lambda op, amount: F.struct(F.lit(op).alias("row_op"), amount.alias("split_total_amount"))
    both = details.withColumn("_d", F.explode(F.array(delivery(0, F.col("split_total_amount")), delivery(seconds, later))))
    return both.select(*[F.col("_d.split_total_amount") if c == "split_total_amount" else F.col(c) for c in details.columns], "_d.row_op")


def with_row_time(rows: DataFrame, as_of_ms: int) -> DataFrame:
    """``row_op_ts``, the wall clock at which a delivery was made, as text that ends in as many digits as it needs.

    The clock is a parameter, so that a run can be repeated.
    """
    ms = F.lit(as_of_ms) + F.col("row_op") * 1000 + F.pmod(F.length("id"), F.lit(10)) * 20
    text = F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z"))
    return rows.withColumn("row_op_ts", F.regexp_replace(text, "0{1,2}Z$", "Z"))


def keep_latest_by_time(rows: DataFrame, *key: str) -> DataFrame:
    """The delivery with the latest ``row_op_ts``, compared as a time whatever its digits; of equal times the later arrival."""
    return latest_of_key(rows, [*(key or ("id",))], [F.desc(instant(F.col("row_op_ts"))), F.desc("row_op")])


def keep_first(rows: DataFrame, *key: str) -> DataFrame:
    """The first delivery of each line; ties by all columns, so the choice is the same every time.

    The key is the line's id by default; with :data:`LINE` lines that lie by their order stay where they are.
    """
    keys = key or ("id",)
    return first_of(rows, [*keys], ["row_op", *sorted(set(rows.columns) - {"row_op", *keys})])


def keep_latest(rows: DataFrame, *key: str) -> DataFrame:
    keys = key or ("id",)
    return latest_of_key(rows, [*keys], [F.desc("row_op"), *[F.desc(c) for c in sorted(set(rows.columns) - {"row_op", *keys})]])


#: The key of a line whose id tells its order, as the shop's do.
LINE = ("order_id", "id")


def cart_add_window(carts: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Users who put something into their cart for the first time that day."""
    rows = carts.withColumn("at", F.coalesce("operate_time", "create_time"))
    firsts = first_of(rows, ["user_id", date_part(F.col("at"))], ["at", "id"])
    return tumble(firsts.withColumn("rt", time_of(F.col("at"))), "rt", [], [F.count(F.lit(1)).alias("cart_add_uu_ct")], size)


def amounts(details: DataFrame) -> DataFrame:
    """What an order line adds to its window."""
    origin = (F.expr("try_cast(sku_num AS DECIMAL(10,0))") * money("order_price")).cast("decimal(24,2)")
    return details.withColumns({"activity": money("split_activity_amount"), "coupon": money("split_coupon_amount"), "origin": origin})


def order_sums() -> list[Column]:
    return [
        F.sum("unique_user").alias("order_unique_user_count"), F.sum("new_user").alias("order_new_user_count"),
        total(F.col("activity")).alias("order_activity_reduce_amount"), total(F.col("coupon")).alias("order_coupon_reduce_amount"),
        total(F.col("origin")).alias("order_origin_total_amount"),
    ]


def order_window(details: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Buyers of the day, first-time buyers, reductions and the amount before them."""
    rows = unique_and_new(details, "user_id", date_part(F.col("create_time")), ["create_time", "id"]).withColumn("rt", time_of(F.col("create_time")))
    return tumble(amounts(rows), "rt", [], order_sums(), size)


def payment_window(payments: DataFrame, size: str = "10 seconds") -> DataFrame:
    rows = unique_and_new(payments, "user_id", date_part(F.col("callback_time")), ["callback_time", "order_detail_id"])
    rows = rows.where("unique_user = 1").withColumn("rt", time_of(F.col("callback_time")))
    return tumble(rows, "rt", [], [F.sum("unique_user").alias("payment_suc_unique_user_count"), F.sum("new_user").alias("payment_suc_new_user_count")], size)


def _orders() -> Column:
    return F.countDistinct("order_id").alias("order_ct")


def user_spu_window(details: DataFrame, dims: dict[str, DataFrame], size: str = "10 seconds") -> DataFrame:
    """Orders and amounts by user, product and trademark. The join that gives the keys stands before the
    aggregate; those that only give names come after it, over fewer rows."""
    rows = enrich(details, dims["sku"], "sku_id", {"spu_id": "spu_id", "tm_id": "trademark_id", "category3_id": "category3_id"}).withColumn("rt", time_of(F.col("create_time")))
    out = tumble(rows, "rt", ["user_id", "trademark_id", "spu_id", "category3_id"], [_orders(), total(money("split_total_amount")).alias("order_amount")], size)
    return name_goods(enrich(out, dims["spu"], "spu_id", {"spu_name": "spu_name"}), dims)


def name_goods(rows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Names of trademark and categories; each level gives the key of the next."""
    rows = enrich(rows, dims["trademark"], "trademark_id", {"tm_name": "trademark_name"})
    rows = enrich(rows, dims["category3"], "category3_id", {"name": "category3_name", "category2_id": "category2_id"})
    rows = enrich(rows, dims["category2"], "category2_id", {"name": "category2_name", "category1_id": "category1_id"})
    return enrich(rows, dims["category1"], "category1_id", {"name": "category1_name"})


def province_window(details: DataFrame, provinces: DataFrame, size: str = "10 seconds") -> DataFrame:
    rows = details.dropna(subset=["user_id", "source_type_name"]).withColumn("rt", time_of(F.col("create_time")))
    out = tumble(rows, "rt", ["province_id"], [_orders(), total(money("split_total_amount")).alias("order_amount")], size)
    return enrich(out, provinces, "province_id", {"name": "province_name"}).withColumn("province_name", F.coalesce("province_name", F.lit("")))


def refund_window(refunds: DataFrame, dims: dict[str, DataFrame], size: str = "10 seconds") -> DataFrame:
    """Refunded orders by trademark, category and user; the key is three columns, so no two keys run together."""
    rows = enrich(refunds, dims["sku"], "sku_id", {"tm_id": "trademark_id", "category3_id": "category3_id"}).withColumn("rt", time_of(F.col("create_time")))
    out = tumble(rows, "rt", ["trademark_id", "category3_id", "user_id"], [F.countDistinct("order_id").alias("refund_ct")], size)
    return name_goods(out, dims)
