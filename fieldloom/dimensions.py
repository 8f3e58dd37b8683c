"""The two fixed dimensions: preset resume keys and form field types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Preset resume keys as (group, category, ((key, label, required), ...)).
PRESET_GROUPS = (
    ("personal", "个人信息", (
        ("name", "姓名", True), ("email", "邮箱", True), ("phone", "电话", True),
        ("address", "地址", False), ("birth_date", "出生日期", False), ("gender", "性别", False),
        ("id_card", "身份证号", False),
    )),
    ("education", "教育经历", (
        ("university", "毕业院校", False), ("degree", "学历", False), ("major", "专业", False),
        ("graduation_date", "毕业时间", False), ("gpa", "GPA", False),
        ("undergraduate_school", "本科学校", False), ("graduate_school", "研究生学校", False),
    )),
    ("experience", "工作经验", (
        ("current_company", "当前公司", False), ("current_position", "当前职位", False),
        ("work_years", "工作年限", False), ("previous_company", "上一家公司", False),
        ("previous_position", "上一个职位", False), ("salary_expectation", "期望薪资", False),
    )),
    ("skills", "技能证书", (
        ("programming_languages", "编程语言", False), ("frameworks", "技术框架", False),
        ("languages", "语言能力", False), ("certifications", "专业证书", False),
        ("soft_skills", "软技能", False),
    )),
)
# Fixed value: the group of keys that are in no preset group.
OTHER_GROUP = "其他"

PRESET_KEYS = {group: tuple(key for key, _, _ in fields) for group, _, fields in PRESET_GROUPS}
ALL_PRESET_KEYS = tuple(key for keys in PRESET_KEYS.values() for key in keys)

# Accepted form field types; those with a name and description are advertised.
FIELD_TYPES = (
    ("text", "文本输入", "单行文本输入框"),
    ("textarea", "多行文本", "多行文本输入框"),
    ("select", "下拉选择", "下拉选择器，需要提供选项"),
    ("radio", "单选按钮", "单选按钮组"),
    ("checkbox", "复选框", "复选框"),
    ("date", "日期", "日期选择器"),
    ("email", "邮箱", "邮箱输入框"),
    ("tel", "电话", "电话号码输入框"),
    ("number", "数字", "数字输入框"),
    ("url", "网址", "URL输入框"),
    ("password", None, None),
    ("time", None, None),
    ("datetime-local", None, None),
    ("month", None, None),
    ("week", None, None),
    ("file", None, None),
)
ACCEPTED_TYPES = tuple(name for name, _, _ in FIELD_TYPES)


def _literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of constants made inside the plan."""
    names = columns.split()
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def preset_fields(spark: SparkSession, group: str | None = None) -> DataFrame:
    """Preset keys in their order, all of them or one group's; an unknown group is empty."""
    rows, position = [], 0
    for name, category, fields in PRESET_GROUPS:
        for key, label, required in fields:
            position += 1
            rows.append((position, name, key, label, category, required))
    table = _literal_table(spark, "position group key label category required", rows).withColumn(
        "placeholder", F.lit(None).cast("string"))
    return table if group is None else table.filter(F.col("group") == group)


def preset_fields_by_group(spark: SparkSession) -> DataFrame:
    """One row per group with its fields in order."""
    fields = F.sort_array(F.collect_list(F.struct(
        "position", "key", "label", "category", "placeholder", "required")))
    return preset_fields(spark).groupBy("group").agg(fields.alias("fields"))


def field_types(spark: SparkSession) -> DataFrame:
    """Accepted field types, with the advertised ones flagged."""
    return _literal_table(spark, "type name description", list(FIELD_TYPES)).withColumn(
        "advertised", F.col("name").isNotNull())
