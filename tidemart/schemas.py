"""Record layouts of the feeds and of the output tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


# --- fixed values: names, texts and times other programs depend on -----------
TOPIC_START = "Topic_Start"
TOPIC_EVENT = "Topic_Event"
TOPIC_ORDER = "TOPIC_ORDER_INFO"
TOPIC_ORDER_DETAIL = "TOPIC_ORDER_DETAIL"
TOPIC_USER = "TOPIC_USER_INFO"

STARTUP_TYPE = "startup"
COUPON_EVENT = "coupon"
CLICK_EVENT = "clickItem"
ROW_ENTRY = "ROWDATA"

ALERT_WINDOW = "5 minutes"
ALERT_MIN_USERS = 3
JOIN_BOUND_SECONDS = 100
CADENCE = "5 seconds"
USER_CADENCE = "3 seconds"

CARD_NAMES = {"dau": "新增日活", "new_mid": "新增设备", "order_amount": "新增交易额"}
AGE_CLASSES = ("20岁以下", "20-30岁", "30岁以上")
GENDER_CLASSES = {"M": "男", "F": "女"}

MASK_VISIBLE = 4
MASK_FILL = "*******"
# ------------------------------------------------------------------------------

# Every leaf arrives as text: change events quote all values, and a typed
# parse of a quoted number would be NULL. Types are set by casts afterwards.
START_LOG = _strings("mid uid appid area os ch type vs ts")
EVENT_LOG = _strings("mid uid appid area os type evid pgid npgid itemid ts")
ORDER = _strings(
    "id province_id consignee order_comment consignee_tel order_status payment_way "
    "user_id img_url total_amount expire_time delivery_address create_time "
    "operate_time tracking_no parent_order_id out_trade_no trade_body")
ORDER_DETAIL = _strings("id order_id sku_name sku_id order_price img_url sku_num")
USER = _strings("id login_name user_level birthday gender")

CHANGE = T.StructType([
    T.StructField("entry_type", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("after", T.MapType(T.StringType(), T.StringType())),
])

RAW = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

DAU_TABLE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in "mid uid appid area os ch type vs".split()],
    T.StructField("ts", T.LongType()),
    T.StructField("log_hour", T.StringType()),
    T.StructField("log_date", T.StringType()),
])

ORDER_TABLE = T.StructType([
    *[T.StructField(f.name, T.DoubleType() if f.name == "total_amount" else T.StringType())
      for f in ORDER.fields],
    T.StructField("create_hour", T.StringType()),
    T.StructField("create_date", T.StringType()),
])

SALE_DETAIL = T.StructType([
    T.StructField("order_detail_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("create_time", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("user_gender", T.StringType()),
    T.StructField("user_age", T.IntegerType()),
    T.StructField("user_level", T.StringType()),
    T.StructField("sku_price", T.DoubleType()),
    T.StructField("sku_name", T.StringType()),
    T.StructField("age_known", T.BooleanType()),
    T.StructField("dt", T.StringType()),
])

ALERT_DOC = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("mid", T.StringType()),
    T.StructField("n_users", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("ts", T.LongType()),
    T.StructField("index_day", T.StringType()),
])

ALERT_MEMBER = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("ts", T.LongType()),
    T.StructField("index_day", T.StringType()),
])


@dataclass(frozen=True)
class Feed:
    """One named input: its topic, layout and the columns a row cannot lack."""

    name: str
    topic: str
    schema: T.StructType
    required: tuple[str, ...]
    numbers: dict[str, str] = field(default_factory=dict)
    cadence: str = CADENCE


FEEDS = {f.name: f for f in (
    Feed("start", TOPIC_START, START_LOG, ("mid", "ts"), {"ts": "bigint"}),
    Feed("event", TOPIC_EVENT, EVENT_LOG, ("mid", "ts"), {"ts": "bigint"}),
    Feed("order", TOPIC_ORDER, ORDER, ("id", "create_time"), {"total_amount": "double"}),
    Feed("order_detail", TOPIC_ORDER_DETAIL, ORDER_DETAIL, ("id", "order_id"),
         {"order_price": "double"}),
    Feed("user", TOPIC_USER, USER, ("id",), {}, USER_CADENCE),
)}
