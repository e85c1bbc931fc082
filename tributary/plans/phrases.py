"""Set phrases that stand for one-line tasks."""

from __future__ import annotations

import re

# The published phrases, and the task each stands for. {source} is a path, words in <> are its parts.
PHRASES = (
    ("整理 <path>", "{source} export id-field {id}"),
    ("把 <path> 做成训练集", "{source} export id-field {id}"),
    ("把 <path> 填充 <field> 空值为 <value>", "{source} prepare fill {field} with {value} export id-field {id}"),
    ("把 <path> 删掉 <field> 为空的行", "{source} prepare drop-missing {field} export id-field {id}"),
    ("把 <path> 只保留 <fields>", "{source} prepare select {fields} export id-field {id}"),
    ("把 <path> 过滤 <field> 大于 <value>", "{source} prepare filter {field} gt {value} export id-field {id}"),
    ("把 <path> 过滤 <field> 小于 <value>", "{source} prepare filter {field} lt {value} export id-field {id}"),
    ("把 <path> 过滤 <field> 等于 <value>", "{source} prepare filter {field} eq {value} export id-field {id}"),
    ("把 <path> 切成 8:1:1", "{source} export train 80 val 10 test 10 id-field {id}"),
    ("把 <path> 的 <field> 改名为 <name>", "{source} prepare rename {field} to {name} export id-field {id}"),
    ("把 <path> 的 <field> 转成数字", "{source} prepare cast {field} as number export id-field {id}"),
    ("把 <path> 的 <field> 转成整数", "{source} prepare cast {field} as integer export id-field {id}"),
    ("把 <path> 的 <field> 转成文本", "{source} prepare cast {field} as string export id-field {id}"),
    ("把 <path> 的 <field> 转成布尔", "{source} prepare cast {field} as boolean export id-field {id}"),
    ("把 <path> 按 <field> 去重", "{source} prepare dedupe by {field} export id-field {id}"),
    ("把 <path> 按 <field> 聚合", "{source} aggregate by {field} record_count=count({field}) export"),
    ("统计 <path> 每个 <field> 的数量", "{source} aggregate by {field} record_count=count({field}) export"),
    ("统计 <path> 每个 <field> 的 <metric> 总和", "{source} aggregate by {field} {metric_sum}=sum({metric}) export"),
    ("统计 <path> 每个 <field> 的 <metric> 均值", "{source} aggregate by {field} {metric_avg}=avg({metric}) export"),
    ("统计 <path> 每个 <field> 的 <metric> 最大", "{source} aggregate by {field} {metric_max}=max({metric}) export"),
    ("统计 <path> 每个 <field> 的 <metric> 最小", "{source} aggregate by {field} {metric_min}=min({metric}) export"),
)
_PART = re.compile(r"<(\w+)>")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_FORMS = [(re.compile(_PART.sub(r"(?P<\1>.+?)", re.sub(r"([.:()])", r"\\\1", phrase)), re.S), task) for phrase, task in PHRASES]


def quoted(text: str) -> str:
    """A quoted word of the task language."""
    return "'" + text.strip().replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scalar(text: str) -> str:
    plain = text.strip().lower()
    return plain if plain in ("null", "true", "false") or _NUMBER.fullmatch(plain) else quoted(text)


def translate(text: str, row_id: str) -> str | None:
    """The task that a phrase stands for, or None; row_id names the generated id. No parts are guessed."""
    for form, task in _FORMS:
        m = form.fullmatch(text.strip())
        if not m or any(not v.strip() or "://" in v for v in m.groupdict().values()):
            continue
        parts = m.groupdict()
        words = {"source": f"from {quoted(parts['path'])} source-id-field auto", "id": row_id}
        words |= {k: quoted(parts[k]) for k in ("field", "name", "metric") if k in parts}
        if "value" in parts:
            words["value"] = _scalar(parts["value"])
        if "metric" in parts:
            words |= {f"metric_{f}": quoted(f"{parts['metric'].strip()}_{f}") for f in ("sum", "avg", "max", "min")}
        if "fields" in parts:
            fields = [quoted(f) for f in re.split("[,，]", parts["fields"]) if f.strip()]
            if not fields:
                continue
            words["fields"] = ",".join(fields)
        return task.format(**words)
    return None
