"""Detailed facts from change data: coupons, interaction, users, carts, orders, payments and refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_of
from ..operators.enrich import lookup
from ..schemas import strings


def changes(db: DataFrame, table: str, kind: str | None = None, database: str | None = None) -> DataFrame:
    rows = db.where(F.col("table") == table)
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.where(F.col("database") == database) if database else rows


def take(rows: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Columns from the row's map; a missing key is null. ``renamed`` is new=old."""
    d = F.col("data")
    return rows.select(*[d[n].alias(n) for n in names], *[d[o].alias(n) for n, o in renamed.items()], *[c for c in ("type", "old", "ts") if c in rows.columns])


def _final(rows: DataFrame, columns: str) -> DataFrame:
    return rows.select(*columns.split())


def coupon_get(db: DataFrame) -> DataFrame:
    rows = take(changes(db, "coupon_use", "insert"), "id", "coupon_id", "user_id", "get_time").withColumn("date_id", day_of(F.col("get_time")))
    return _final(rows, "id coupon_id user_id date_id get_time ts")


def coupon_order(db: DataFrame) -> DataFrame:
    used = changes(db, "coupon_use", "update").where("data['coupon_status'] = '1402' AND old['coupon_status'] = '1401'")
    rows = take(used, "id", "coupon_id", "user_id", "order_id", order_time="using_time").withColumn("date_id", day_of(F.col("order_time")))
    return _final(rows, "id coupon_id user_id order_id date_id order_time ts")


def coupon_pay(db: DataFrame) -> DataFrame:
    used = changes(db, "coupon_use", "update").where("data['used_time'] IS NOT NULL")
    rows = take(used, "id", "coupon_id", "user_id", "order_id", payment_time="used_time").withColumn("date_id", day_of(F.col("payment_time")))
    return _final(rows, "id coupon_id user_id order_id date_id payment_time ts")


def favor_add(db: DataFrame) -> DataFrame:
    rows = take(changes(db, "favor_info", "insert"), "id", "user_id", "sku_id", "create_time").withColumn("date_id", day_of(F.col("create_time")))
    return _final(rows, "id user_id sku_id date_id create_time ts")


def comment(db: DataFrame, dic: DataFrame) -> DataFrame:
    rows = take(changes(db, "comment_info", "insert"), "id", "user_id", "sku_id", "order_id", "create_time", appraise_code="appraise")
    rows = lookup(rows, dic, "appraise_code", "appraise_name").withColumn("date_id", day_of(F.col("create_time")))
    return _final(rows, "id user_id sku_id order_id date_id create_time appraise_code appraise_name ts")


def user_register(db: DataFrame) -> DataFrame:
    rows = take(changes(db, "user_info", "insert"), "create_time", user_id="id").withColumn("date_id", day_of(F.col("create_time")))
    return _final(rows, "user_id date_id create_time ts")


def cart_add(db: DataFrame, dic: DataFrame) -> DataFrame:
    """New cart rows, and what was added where a row's number grew."""
    now, was = F.expr("try_cast(data['sku_num'] AS INT)"), F.expr("try_cast(old['sku_num'] AS INT)")
    rows = changes(db, "cart_info", database="shop").where((F.col("type") == "insert") | ((F.col("type") == "update") & (now > was)))
    names = "id user_id sku_id cart_price sku_num sku_name is_checked create_time operate_time is_ordered order_time source_id"
    rows = take(rows, *names.split(), source_type_id="source_type")
    grown = F.expr("CAST(try_cast(sku_num AS INT) - try_cast(old['sku_num'] AS INT) AS STRING)")
    rows = lookup(rows.withColumn("sku_num", F.when(F.col("type") == "insert", F.col("sku_num")).otherwise(grown)), dic, "source_type_id", "source_type_name")
    return _final(rows, "id user_id sku_id cart_price sku_num sku_name is_checked create_time operate_time is_ordered order_time source_type_id source_type_name source_id")


# The names of the columns of the change data and of the topics.
ORDER = "consignee consignee_tel total_amount order_status user_id payment_way delivery_address order_comment out_trade_no trade_body operate_time expire_time process_status tracking_no parent_order_id province_id activity_reduce_amount coupon_reduce_amount original_total_amount feight_fee feight_fee_reduce refundable_time"
DETAIL = "id order_id sku_id sku_name order_price sku_num create_time source_id split_total_amount split_activity_amount split_coupon_amount"


def order_pre_process(db: DataFrame, dic: DataFrame, orders: DataFrame | None = None, by_order: bool = False) -> DataFrame:
    """Order lines with their order, activity, coupon and source: the wide row that orders and cancellations come from.

    Lines, activities and coupons are read in one pass and meet by the line's id in one shuffle; several partners of a
    line give several rows, as in left joins. ``orders`` are the changes of orders where they are a topic apart.

    ``by_order`` says that the topic's rows have a key ``order_id``, that of a partner being its line's, as the shop's are: all of an order
    then meets by it, so lines that come in that way are not shuffled again.
    """
    d, kind = F.col("data"), F.col("table")
    order = take(changes(db if orders is None else orders, "order_info", database="shop").where(F.col("type").isin("insert", "update")), *ORDER.split(), _order="id").drop("ts")
    parts = {
        "order_detail": {**{n: n for n in DETAIL.split() if not (by_order and n == "order_id")}, "source_type_id": "source_type"},
        "order_detail_activity": {"order_detail_activity_id": "id", "activity_id": "activity_id", "activity_rule_id": "activity_rule_id"},
        "order_detail_coupon": {"order_detail_coupon_id": "id", "coupon_id": "coupon_id", "coupon_use_id": "coupon_use_id"},
    }
    lines = db.where(kind.isin(*parts) & (F.col("type") == "insert") & (F.col("database") == "shop"))
    key = F.when(kind == "order_detail", d["id"]).otherwise(d["order_detail_id"])
    own = ["order_id"] if by_order else []
    each = lines.select(*own, key.alias("_line"), *[F.when(kind == t, F.struct(*[d[old].alias(new) for new, old in names.items()])).alias(t) for t, names in parts.items()])
    # A line without an id has no partners; such lines are spread, and partners that name no line go.
    each = each.where("_line IS NOT NULL OR order_detail IS NOT NULL").withColumn("_apart", F.when(F.col("_line").isNull(), F.pmod(F.xxhash64("order_detail"), F.lit(1024))))
    met = each.groupBy(*own, "_line", "_apart").agg(*[F.collect_list(t).alias(t) for t in parts])
    met = met.select(*own, F.explode("order_detail").alias("l"), "order_detail_activity", "order_detail_coupon").select(*own, "l", F.explode_outer("order_detail_activity").alias("a"), "order_detail_coupon").select(*own, "l", "a", F.explode_outer("order_detail_coupon").alias("c"))
    detail = met.select(*own, "l.*", "a.*", "c.*")
    wide = lookup(detail, dic, "source_type_id", "source_type_name").join(order, F.col("order_id") == F.col("_order"))
    return wide.select(*"id order_id sku_id sku_name order_price sku_num create_time source_type_id source_type_name source_id split_total_amount split_activity_amount split_coupon_amount".split(), *ORDER.split(), "order_detail_activity_id", "activity_id", "activity_rule_id", "order_detail_coupon_id", "coupon_id", "coupon_use_id", "type", "old")


ORDER_DETAIL = "id order_id user_id sku_id sku_name sku_num order_price province_id activity_id activity_rule_id coupon_id create_time source_id source_type_id source_type_name split_activity_amount split_coupon_amount split_total_amount"


#: The topic of order lines: all columns are text.
DETAIL_TOPIC = strings(*ORDER_DETAIL.split())


def order_detail(wide: DataFrame, *more: str) -> DataFrame:
    return _final(wide.where("type = 'insert'"), " ".join([ORDER_DETAIL, *more]))


def cancel_detail(wide: DataFrame) -> DataFrame:
    rows = wide.where("type = 'update' AND old['order_status'] IS NOT NULL AND order_status = '1003'").withColumnRenamed("operate_time", "cancel_time")
    return _final(rows, ORDER_DETAIL.replace("create_time", "cancel_time"))


def pay_detail_suc(db: DataFrame, details: DataFrame, dic: DataFrame) -> DataFrame:
    """Each line of a paid order; lines without a known way of payment go."""
    paid = changes(db, "payment_info", "update").where("data['payment_status'] = '1602'")
    paid = take(paid, "callback_time", _order="order_id", _user="user_id", payment_type_code="payment_type").drop("type", "old", "ts")
    rows = lookup(paid, dic, "payment_type_code", "payment_type_name").join(details, F.col("_order") == F.col("order_id"))
    rows = rows.withColumns({"order_detail_id": F.col("id"), "split_payment_amount": F.col("split_total_amount"), "user_id": F.col("_user")})
    return _final(rows, "order_detail_id order_id user_id sku_id sku_name province_id activity_id activity_rule_id coupon_id payment_type_code payment_type_name callback_time source_id source_type_id source_type_name sku_num order_price split_activity_amount split_coupon_amount split_payment_amount")


def _status(db: DataFrame, status: str) -> DataFrame:
    rows = changes(db, "order_info", "update").where(F.col("data")["order_status"] == status).where("old['order_status'] IS NOT NULL")
    return take(rows, "province_id", _order="id", _buyer="user_id").drop("type", "old", "ts")


def order_refund(db: DataFrame, dic: DataFrame) -> DataFrame:
    asked = take(changes(db, "order_refund_info", "insert"), *"id user_id order_id sku_id refund_num refund_amount refund_reason_txt create_time".split(), refund_type_code="refund_type", refund_reason_type_code="refund_reason_type")
    rows = lookup(lookup(asked, dic, "refund_type_code", "refund_type_name"), dic, "refund_reason_type_code", "refund_reason_type_name")
    rows = rows.join(_status(db, "1005"), F.col("order_id") == F.col("_order")).withColumn("date_id", day_of(F.col("create_time")))
    return _final(rows, "id user_id order_id sku_id province_id date_id create_time refund_type_code refund_type_name refund_reason_type_code refund_reason_type_name refund_reason_txt refund_num refund_amount ts")


def refund_pay_suc(db: DataFrame, dic: DataFrame) -> DataFrame:
    """Paid refunds with the order and the number of goods sent back; repeated requests for a line count once."""
    paid = changes(db, "refund_payment", "update").where("data['refund_status'] = '0702' AND old['refund_status'] IS NOT NULL")
    paid = take(paid, "id", "order_id", "sku_id", "callback_time", payment_type_code="payment_type", refund_amount="total_amount")
    asked = take(changes(db, "order_refund_info"), "order_id", "sku_id", "refund_num").groupBy("order_id", "sku_id").agg(F.max("refund_num").alias("refund_num"))
    rows = lookup(paid, dic, "payment_type_code", "payment_type_name").join(_status(db, "1006"), F.col("order_id") == F.col("_order")).join(asked, ["order_id", "sku_id"])
    rows = rows.withColumns({"user_id": F.col("_buyer"), "date_id": day_of(F.col("callback_time"))})
    return _final(rows, "id user_id order_id sku_id province_id payment_type_code payment_type_name date_id callback_time refund_num refund_amount ts")
