"""Form matching around a model: checking requests, building prompts, reading answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import dimensions, schemas
from fieldloom.functions import model_json
from fieldloom.functions.numbers import ratio
from fieldloom.functions.text import is_blank, list_literal
from fieldloom.operators.skew import skew_join

# Fixed value: the prompt around the resume text and the numbered field list.
PROMPT_TEMPLATE = """
你是一个专业的简历信息提取和表单填写助手。

请根据以下简历信息，为给定的表单字段提供合适的填写内容。

【简历信息】：
{resume_text}

【表单字段】：
{fields}

【任务要求】：
1. 仔细分析简历信息，理解候选人的背景
2. 为每个表单字段匹配最合适的内容
3. 如果简历中没有相关信息，返回空字符串
4. 对于选择类型的字段，请从给定选项中选择最匹配的
5. 日期格式请统一为 YYYY-MM-DD 或 YYYY-MM 格式
6. 电话号码保持原格式
7. 地址信息要具体到城市

【输出格式】：
请直接返回一个JSON数组，包含所有匹配结果，不要包含任何其他内容：

[
    {
        "field_name": "字段名",
        "field_type": "字段类型",
        "matched_value": "匹配的值"
    }
]
"""

# The words of a form field's descriptor.
NAME_WORD, LABEL_WORD, PLACEHOLDER_WORD, TYPE_WORD, OPTIONS_WORD = "字段名", "标签", "占位符", "类型", "选项"


# --- checking requests -------------------------------------------------------

def field_violation(name: Column, type_: Column, options: Column) -> Column:
    """The first thing wrong with one form field, or null."""
    return (
        F.when(is_blank(name), "blank_name")
        .when(~F.coalesce(type_.isin(*dimensions.ACCEPTED_TYPES), F.lit(False)), "bad_type")
        .when((type_ == "select") & (F.coalesce(F.size(options), F.lit(0)) <= 0), "missing_options")
    )


def _size_problem(n_fields: Column) -> Column:
    return (F.when(F.coalesce(n_fields, F.lit(0)) == 0, "no_fields")
            .when(n_fields > schemas.MAX_FORM_FIELDS, "too_many_fields"))


def _subject(reason: Column, name: Column, type_: Column) -> Column:
    """What the message on a violation names."""
    return F.when(reason == "bad_type", type_).when(reason == "missing_options", name)


def validate_forms(requests: DataFrame) -> DataFrame:
    """Verdict per request on its nested ``form_fields``: reason, 1-based position, subject."""
    def check(field: Column, index: Column) -> Column:
        reason = field_violation(field["name"], field["type"], field["options"])
        return F.struct((index + 1).alias("pos"), reason.alias("reason"),
                        _subject(reason, field["name"], field["type"]).alias("subject"))

    broken = F.filter(F.transform("form_fields", check), lambda c: c["reason"].isNotNull())
    first, too = F.try_element_at(broken, F.lit(1)), _size_problem(F.size("form_fields"))
    return requests.select(
        "request_id",
        F.coalesce(too, first["reason"], F.lit("ok")).alias("form_verdict"),
        F.when(too.isNull(), first["pos"]).alias("bad_pos"),
        F.when(too.isNull(), first["subject"]).alias("bad_subject"))


_REASONS = ("blank_name", "bad_type", "missing_options")


def form_totals(form_fields: DataFrame, *extra: Column) -> DataFrame:
    """Number of fields and first violation per request, from form fields in long form.

    Position and reason travel as one number, which keeps the aggregation a
    hash aggregation on both sides of the shuffle.
    """
    reason = field_violation(F.col("name"), F.col("type"), F.col("options"))
    code = F.array_position(F.array(*[F.lit(r) for r in _REASONS]), reason)
    checked = form_fields.withColumn("_reason", reason).withColumn(
        "_violation", F.col("pos").cast("long") * (len(_REASONS) + 1) + code)
    totals = checked.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_fields"), F.min("_violation").alias("_first"), *extra)
    return totals.withColumns({
        "bad_pos": F.floor(F.col("_first") / (len(_REASONS) + 1)).cast("int"),
        "bad_reason": F.try_element_at(F.array(*[F.lit(r) for r in _REASONS]),
                                       (F.col("_first") % (len(_REASONS) + 1)).cast("int")),
    }).drop("_first")


def with_form_verdict(requests: DataFrame, form_fields: DataFrame) -> DataFrame:
    """Requests with the verdict on their form fields and ``n_fields``."""
    joined = requests.join(form_totals(form_fields), "request_id", "left")
    return joined.select(
        *requests.columns, F.coalesce("n_fields", F.lit(0)).alias("n_fields"),
        F.coalesce(_size_problem(F.col("n_fields")), "bad_reason", F.lit("ok")).alias("form_verdict"))


def validate_form_fields(requests: DataFrame, form_fields: DataFrame) -> DataFrame:
    """The verdict with the position and subject its message names.

    Only the first violation travels through the shuffle, not the fields.
    """
    subject = F.min(F.when(F.col("_reason").isNotNull(), F.struct(
        "pos", _subject(F.col("_reason"), F.col("name"), F.col("type")).alias("subject")))).alias("_bad")
    totals = form_totals(form_fields, subject)
    too = _size_problem(F.col("n_fields"))
    return requests.select("request_id").join(totals, "request_id", "left").select(
        "request_id", F.coalesce("n_fields", F.lit(0)).alias("n_fields"),
        F.coalesce(too, "bad_reason", F.lit("ok")).alias("form_verdict"),
        F.when(too.isNull(), F.col("bad_pos")).alias("bad_pos"),
        F.when(too.isNull(), F.col("_bad.subject")).alias("bad_subject"))


# --- prompts -----------------------------------------------------------------

def field_descriptor(name: Column, type_: Column, label: Column, placeholder: Column, options: Column) -> Column:
    """One line on a form field; label, placeholder and options only when not empty."""
    def part(word: str, value: Column) -> Column:
        return F.concat(F.lit(f", {word}: "), value)

    def optional(word: str, value: Column, present: Column) -> Column:
        return F.coalesce(F.when(present, part(word, value)), F.lit(""))

    return F.concat(
        F.lit(f"{NAME_WORD}: "), name, optional(LABEL_WORD, label, label != ""),
        optional(PLACEHOLDER_WORD, placeholder, placeholder != ""), part(TYPE_WORD, type_),
        optional(OPTIONS_WORD, list_literal(options), F.size(options) > 0))


def describe_fields(form_fields: DataFrame) -> DataFrame:
    """A descriptor per form field in long form."""
    return form_fields.select("request_id", "pos", field_descriptor(
        F.col("name"), F.col("type"), F.col("label"), F.col("placeholder"), F.col("options")).alias("descriptor"))


def numbered(descriptors: Column) -> Column:
    """An ordered array of descriptors as lines ``1. ...``."""
    lines = F.transform(descriptors, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d))
    return F.array_join(lines, "\n")


def field_lines(form_fields: DataFrame) -> DataFrame:
    """Numbered descriptors of each request whose form is valid.

    A valid form has at most 50 fields, so what one group collects is bounded;
    larger forms are gone before anything is collected.
    """
    valid = form_totals(form_fields).filter(
        (F.col("n_fields") <= schemas.MAX_FORM_FIELDS) & F.col("bad_reason").isNull())
    kept = skew_join(form_fields, valid.select("request_id"), ["request_id"], "left_semi", ["pos"])
    return describe_fields(kept).groupBy("request_id").agg(
        numbered(F.transform(F.array_sort(F.collect_list(F.struct("pos", "descriptor"))),
                             lambda d: d["descriptor"])).alias("fields_text"))


def prompt_text(resume_text: Column, fields_text: Column) -> Column:
    before, rest = PROMPT_TEMPLATE.split("{resume_text}")
    between, after = rest.split("{fields}")
    return F.concat(F.lit(before), resume_text, F.lit(between), fields_text, F.lit(after))


# --- answers -----------------------------------------------------------------

def with_answer(outputs: DataFrame) -> DataFrame:
    """Rows with ``status_code`` and ``output_text`` replaced by a verdict and the valid matches.

    Row by row, so the same for a batch and for a stream.
    """
    elements = model_json.parse_elements(model_json.array_slice(F.col("output_text")))
    parsed = outputs.withColumn("_elements", F.when(F.col("status_code") == 200, elements))
    verdict = model_json.answer_verdict(F.col("status_code"), F.col("output_text"), F.col("_elements"))
    return parsed.withColumns({
        "answer_verdict": verdict,
        "matches": F.when(verdict == model_json.OK, model_json.valid_matches(F.col("_elements"))),
    }).drop("status_code", "output_text", "_elements")


def read_answers(outputs: DataFrame) -> DataFrame:
    return with_answer(outputs.select("request_id", "status_code", "output_text"))


def match_rows(answers: DataFrame) -> DataFrame:
    """Valid matches in long form."""
    return answers.select("request_id", F.posexplode("matches").alias("pos", "m")).select(
        "request_id", "pos", "m.field_name", "m.field_type", "m.matched_value")


def success_count(matches: Column) -> Column:
    """Every valid match, empty values included."""
    return F.coalesce(F.size(matches), F.lit(0))


def matched_fields(matches: Column) -> Column:
    """Matches with a value."""
    return F.coalesce(F.size(F.filter(matches, lambda m: m["matched_value"] != "")), F.lit(0))


def match_summary(answers: DataFrame, form_fields: DataFrame) -> DataFrame:
    """Per request with a readable answer: fields asked for, fields matched, and the rate."""
    totals = form_fields.groupBy("request_id").agg(F.count(F.lit(1)).alias("total_fields"))
    counted = answers.filter(F.col("answer_verdict") == model_json.OK).select(
        "request_id", matched_fields(F.col("matches")).alias("matched_fields"))
    return counted.join(totals, "request_id", "left").select(
        "request_id", F.coalesce("total_fields", F.lit(0)).alias("total_fields"), "matched_fields",
        ratio(F.col("matched_fields"), F.coalesce("total_fields", F.lit(0))).alias("match_rate"))
