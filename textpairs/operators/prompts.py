"""Prompt rendering (G07, G08) and few-shot examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt templates and chat texts (must equal the reference's).
INSTRUCTION_PREFIX = "Instruction:\n"
INPUT_MARK = "\n\nInput:\n"
RESPONSE_MARK = "\n\nResponse:\n"
CHAT_SYSTEM = "你是一个中文拼写错误修改助手"
CHAT_PREFIX = "请修改句子中的拼写错误，要求修改后的句子和原句长度相同, 如果句子中没有错误，请直接照抄原句。\n"
# ---------------------------------------------------------------------------


def _c(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def render_prompt(instruction: str | Column, input_: str | Column) -> Column:
    """``Instruction:\\n{instruction}\\n\\nInput:\\n{input}\\n\\nResponse:\\n``."""
    return F.concat(F.lit(INSTRUCTION_PREFIX), _c(instruction), F.lit(INPUT_MARK), _c(input_), F.lit(RESPONSE_MARK))


def few_shot_block(train: DataFrame, order: str, src: str, trg: str, k: int) -> DataFrame:
    """The first ``k`` training pairs in order, rendered as ``src\\ntrg\\n`` lines
    into ONE row (``k`` is the feature: a bounded top-k, planned as TakeOrdered)."""
    first = train.orderBy(order).limit(k).select(order, src, trg)
    line = F.concat(F.col(src), F.lit("\n"), F.col(trg), F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return first.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("few_shot"))


def with_few_shot(test: DataFrame, block: DataFrame) -> DataFrame:
    """The shared few-shot prompt attached to every test row (one-row broadcast)."""
    return test.crossJoin(F.broadcast(block))


def chat_prompt(src: str | Column, few_shot: str | Column) -> Column:
    """System + user messages: fixed prefix, few-shot lines, then the sentence."""
    user = F.concat(F.lit(CHAT_PREFIX), F.coalesce(_c(few_shot), F.lit("")), _c(src))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(CHAT_SYSTEM).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
