"""Column expressions over texts, rules and guidelines (all JVM-side).

Each helper returns a ``Column`` so callers keep whole-stage codegen; none of
them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must agree with the workflow's text conventions.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"   # U+0000..U+001F except TAB, LF, CR
EDGE_SECTION = "Edge Case Handling:"
LABELS_SECTION = "Labels:"
RULE_ARROW = "->"
EMPTY_RULE = "EMPTY"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


WHITESPACE = " \t\n\x0b\x0c\r"   # the \s class of Java regular expressions


def ws_trim(c: str | Column) -> Column:
    """Strip all leading/trailing whitespace (plain ``trim`` strips spaces only).

    Built-in ``trim`` with an explicit character set: the same result as the
    whitespace regex, several times faster on long texts.
    """
    return F.trim(col(c), F.lit(WHITESPACE))


_CONTROL_SET = "".join(chr(i) for i in range(0x20) if i not in (0x09, 0x0A, 0x0D))


def strip_controls(c: str | Column) -> Column:
    """Drop control characters except tab, line feed and carriage return
    (``translate`` deletes the 29 characters, looking up each one; texts without any are only scanned for them)."""
    return F.when(col(c).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.translate(col(c), _CONTROL_SET, "")).otherwise(col(c))


def clean_text(c: str | Column) -> Column:
    """P2 order: trim, then strip control characters."""
    return strip_controls(ws_trim(c))


def text_key(c: str | Column) -> Column:
    """Join key for long texts: shuffles carry 64 hex chars, not the text."""
    return F.sha2(col(c), 256)


def is_empty_rule(c: str | Column) -> Column:
    """P5: a rule is absent when null or ``EMPTY`` (trimmed, any case)."""
    return col(c).isNull() | (F.upper(ws_trim(c)) == EMPTY_RULE)


def rule_condition(c: str | Column) -> Column:
    """Text before the first ``->``, trimmed; the whole rule without an arrow."""
    return ws_trim(F.substring_index(col(c), RULE_ARROW, 1))


def rule_key_number(c: str | Column) -> Column:
    """``edge_case_12`` -> 12, else the first run of digits; null if none."""
    named = F.regexp_extract(col(c), r"edge_case_(\d+)", 1)
    first = F.regexp_extract(col(c), r"(\d+)", 1)
    picked = F.when(named != "", named).when(first != "", first)
    return picked.try_cast("int")


def guideline_task(c: str | Column) -> Column:
    """task text = everything before the ``Labels:`` line, trimmed."""
    return ws_trim(F.regexp_extract(col(c), r"(?s)^(.*?)(\n[ \t]*Labels:|$)", 1))


def guideline_label_lines(c: str | Column) -> Column:
    """array of labels = lines starting with ``-`` after ``Labels:``.

    Lines stop at ``Edge Case Handling:`` so saved rules never become labels
    (ledger L2). Returns ``ARRAY<STRING>`` in guideline order.
    """
    after = F.regexp_extract(col(c), r"(?s)\n[ \t]*Labels:(.*)$", 1)
    before_rules = F.substring_index(after, EDGE_SECTION, 1)
    lines = F.split(before_rules, "\n")
    dashed = F.filter(lines, lambda s: F.startswith(ws_trim(s), F.lit("-")))
    return F.transform(dashed, lambda s: ws_trim(F.regexp_replace(ws_trim(s), r"^-+", "")))


def compose_guideline(task: str | Column, labels: str | Column) -> Column:
    """``task`` + blank line + ``Labels:`` + one ``- label`` line each."""
    lines = F.transform(col(labels), lambda s: F.concat(F.lit("- "), s))
    return F.concat(col(task), F.lit("\n\n" + LABELS_SECTION + "\n"), F.array_join(lines, "\n"))


def split_template(template: str, first: str = "{guideline}", second: str = "{text}"):
    """break a prompt template into the literal parts around two slots.

    Doubled braces are the template's escaped literal braces. Substituting by
    concatenation means a ``{text}`` written inside a guideline stays as it is.
    """
    head, rest = template.split(first, 1)
    middle, tail = rest.split(second, 1)
    unescape = lambda s: s.replace("{{", "{").replace("}}", "}")
    return unescape(head), unescape(middle), unescape(tail)


def render_prompt(template: str, guideline: str | Column, text: str | Column) -> Column:
    """one prompt per row from a template with ``{guideline}`` and ``{text}``."""
    head, middle, tail = split_template(template)
    return F.concat(F.lit(head), col(guideline), F.lit(middle), col(text), F.lit(tail))


def labels_table(guidelines: DataFrame, guideline_col: str = "guideline",
                 keys: tuple[str, ...] = ("task_id", "version")) -> DataFrame:
    """F1 as a table: ``(keys..., idx, label)``, idx 0-based in guideline order."""
    return guidelines.select(
        *keys, F.posexplode(guideline_label_lines(guideline_col)).alias("idx", "label"))
