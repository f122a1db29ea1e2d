"""A message log of any size for trials: every value is a hash of the seed, the row and what it is drawn for.

So the log is the same however many tasks make it. Scenarios are drawn by Walker's alias method from a table of their
weights: one uniform number picks a column, another one its owner or its alias. It stands for no real conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.hashing import shard_number
from parley.settings import DEFAULTS, Settings

#: (name, weight, what a customer says, what a manager answers); {} is a drawn number.
SCENARIOS = (
    ("wealth product due", 14, "我买的{}号理财产品到期了，收益怎么样", "到期收益已经入账，可以看看新的产品"), ("early repayment", 12, "房贷还剩{}万，提前还款要付违约金吗", "满一年提前还款没有违约金"),
    ("deposit rate", 11, "{}万存三年定期，利率现在是多少", "三年定期利率下调了，我帮您算一下"), ("fund loss", 10, "基金又跌了{}个点，要不要赎回", "建议看长期配置，先不要急着赎回"),
    ("card limit", 9, "信用卡额度能提到{}万吗", "可以在线申请提额，我帮您看看"), ("instalments", 8, "账单{}元分期手续费怎么算", "分十二期的手续费率最低"),
    ("insurance", 7, "给孩子买的保险每年交{}元，能退吗", "退保有损失，建议先看保单条款"), ("study abroad", 6, "孩子明年留学，换汇{}美元怎么办理", "带上录取通知书可以办理购汇"),
    ("pension", 6, "个人养老金账户一年存{}元划算吗", "存入金额可以抵扣个人所得税"), ("app trouble", 5, "手机银行转账{}元一直提示失败", "请更新到最新版本再试一次"),
    ("gold", 4, "黄金涨到{}元一克了还能买吗", "可以小额定投，不要追高"), ("business loan", 3, "公司想贷款{}万周转，需要什么材料", "需要营业执照和近半年流水"),
    ("complaint", 3, "排队等了{}分钟没有人接待，很不满意", "非常抱歉，我马上为您处理"), ("trust", 2, "想用{}万设立家族信托传给孩子", "我请信托顾问和您详细沟通"),
)
CHITCHAT = ("好的", "谢谢", "在吗", "收到", "嗯嗯")
CHITCHAT_SHARE, OTHER_SHARE = 0.15, 0.08
OTHER_TYPES = ("image", "voice", "file")


def alias_table(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """(share of its column that an owner keeps, who has the rest), by Vose's two lists."""
    n, total = len(weights), sum(weights)
    share, alias = [w * n / total for w in weights], list(range(n))
    small, large = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while small and large:
        i, j = small.pop(), large[-1]
        alias[i] = j
        share[j] -= 1 - share[i]
        if share[j] < 1:
            small.append(large.pop())
    for i in (*small, *large):
        share[i] = 1.0
    return share, alias


def uniform(seed: int, draw: str, row: str | Column = "id") -> Column:
    """A number from 0 on and below 1 for each row and purpose."""
    return F.xxhash64(F.lit(seed), F.lit(draw), F.col(row) if isinstance(row, str) else row).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def _below(n: int, seed: int, draw: str, row: str | Column = "id") -> Column:
    return F.floor(uniform(seed, draw, row) * n).cast("int")


def scenario(seed: int, row: str | Column = "id", weights: Sequence[float] = tuple(s[1] for s in SCENARIOS)) -> Column:
    share, alias = alias_table(weights)
    column = _below(len(weights), seed, "scenario", row)
    own = F.element_at(F.array(*map(F.lit, share)), column + 1) > uniform(seed, "alias", row)
    return F.when(own, column).otherwise(F.element_at(F.array(*map(F.lit, alias)), column + 1))


def synthetic_log(spark: SparkSession, dialogues: int, seed: int = 42, start: str = "2024-01-01", days: int = 30, staff: int = 30, customers: int = 1000, s: Settings = DEFAULTS) -> DataFrame:
    """The raw log's columns and the scenario and shard of each message: ``dialogues`` of 2 to 9 messages, a minute or so apart.

    A customer opens, manager and customer take turns. Some messages are chitchat, some are no text. message ids count
    from 0 in steps of 16 a dialogue.
    """
    rows = spark.range(dialogues).withColumnRenamed("id", "dialogue")
    of = lambda n, draw: _below(n, seed, draw, "dialogue")
    rows = rows.select("dialogue", scenario(seed, "dialogue").alias("_s"), F.concat(F.lit(s.customer_prefixes[0]), of(customers, "customer").cast("string")).alias("_customer"), F.concat(F.lit("m"), of(staff, "staff").cast("string")).alias("_staff"), (of(days, "day").cast("long") * 86_400 + 28_800 + of(36_000, "second")).alias("_at"), (2 + of(8, "length")).alias("_n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k")).withColumn("id", F.col("dialogue") * 16 + F.col("k"))
    texts = {k: F.element_at(F.array(*(F.lit(x[k]) for x in SCENARIOS)), F.col("_s") + 1) for k in (0, 2, 3)}
    asks = F.col("k") % 2 == 0
    said = F.replace(F.when(asks, texts[2]).otherwise(texts[3]), F.lit("{}"), (1 + _below(99, seed, "number")).cast("string"))
    small = F.element_at(F.array(*map(F.lit, CHITCHAT)), 1 + _below(len(CHITCHAT), seed, "chitchat"))
    kind = F.when((F.col("k") > 0) & (uniform(seed, "other") < OTHER_SHARE), F.element_at(F.array(*map(F.lit, OTHER_TYPES)), 1 + _below(len(OTHER_TYPES), seed, "type"))).otherwise("text")
    content = F.when(F.col("msg_type") != "text", "").when((F.col("k") > 0) & (uniform(seed, "small") < CHITCHAT_SHARE), small).otherwise(said)
    at = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(start))) + F.col("_at") + F.col("k") * 60 + _below(30, seed, "pause"))
    out = rows.withColumn("msg_type", kind).withColumn("content", content).withColumn("msg_time", at)
    sender, receiver = F.when(asks, F.col("_customer")).otherwise(F.col("_staff")), F.when(asks, F.col("_staff")).otherwise(F.col("_customer"))
    out = out.select(
        "id", F.concat(F.lit("msg-"), F.col("id").cast("string")).alias("msg_id"), "content", F.date_format("msg_time", "yyyy-MM-dd").alias("create_date"), F.date_format("msg_time", "HH:mm:ss").alias("create_time"), "msg_time",
        sender.alias("from_user"), receiver.alias("to_user"), F.lit("").alias("room_id"), "msg_type", F.col("msg_time").alias("db_time"), F.unix_millis("msg_time").alias("msg_time_long"), F.lit("").alias("msg_body"), F.lit("").alias("action_text"), F.lit(0).alias("scene"), texts[0].alias("scenario"),
    )
    return out.withColumn("shard", shard_number(F.col("from_user"), s.shard_count))


def log_statistics(log: DataFrame) -> DataFrame:
    """(create_date, messages, texts, senders, first_time, last_time) of each day of a raw log."""
    return log.groupBy("create_date").agg(F.count("*").alias("messages"), F.count_if(F.col("msg_type") == "text").alias("texts"), F.countDistinct("from_user").alias("senders"), F.min("msg_time").alias("first_time"), F.max("msg_time").alias("last_time"))
